"""Lookup in a bucketed memory behind a Bloom filter."""

import pytest
from pyspark.sql import functions as F

from glossweave.functions.text import fingerprint
from glossweave.operators import large_memory as lm
from glossweave.operators.memory import tm_lookup


@pytest.fixture(scope="module")
def memory(spark):
    sources = spark.range(3000).select(F.concat(F.lit("known "), F.col("id").cast("string")).alias("source"))
    return sources.select(
        fingerprint(F.col("source")).alias("fp"), F.concat(F.lit("T:"), "source").alias("target"), F.lit(1).alias("engine")
    )


@pytest.fixture(scope="module")
def segments(spark):
    rows = [(i, f"known {i}" if i % 3 else f"new {i}") for i in range(2000)] + [(9000, None), (9001, ""), (9002, "KNOWN  7 ")]
    return spark.createDataFrame(rows, "id long, text string").withColumns({c: F.lit("clash") for c in ("block", "bits", "words")})


@pytest.fixture(scope="module")
def stored_memory(spark, memory):
    return lm.write_memory(memory, 8), lm.build_filter(memory)


def rows(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def test_same_rows_as_the_plain_lookup(spark, memory, segments, stored_memory):
    assert rows(lm.tm_lookup_large(spark, segments, *stored_memory)) == rows(tm_lookup(segments, memory))


def test_the_filter_has_no_false_negatives_and_few_false_positives(spark, memory, stored_memory):
    known = lm.probe(memory.select("fp"), stored_memory[1])
    assert known.filter("NOT _maybe").count() == 0
    other = spark.range(20_000).select(fingerprint(F.concat(F.lit("unknown "), F.col("id").cast("string"))).alias("fp"))
    assert lm.probe(other, stored_memory[1]).filter("_maybe").count() < 400


def test_the_memory_is_not_shuffled(spark, segments, stored_memory):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lm.tm_lookup_large(spark, segments, *stored_memory)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1  # of the segments that pass
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan


def test_a_filter_that_is_too_large_is_not_sent(spark, memory, segments, stored_memory, monkeypatch):
    monkeypatch.setattr(lm, "BROADCAST_BYTES", 1)
    found = lm.tm_lookup_large(spark, segments, *stored_memory)
    assert "_block" not in found._jdf.queryExecution().toString()
    assert rows(found) == rows(tm_lookup(segments, memory))


def test_an_empty_memory(spark, memory, segments):
    none = memory.filter("1 = 0")
    found = lm.tm_lookup_large(spark, segments, lm.write_memory(none, 8), lm.build_filter(none))
    assert found.count() == segments.count() and found.filter("target IS NOT NULL").isEmpty()
