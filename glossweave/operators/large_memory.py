"""Lookup against a very large memory: stored in buckets, behind a Bloom filter.

The memory is written once, in buckets by fingerprint, and is never shuffled afterwards.
Its Bloom filter is a small table of its own that is built once and read by every lookup:
segments the filter rules out are misses at once and cross no network, all others go to
the bucket of their fingerprint, where the join removes false positives.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossweave.functions.text import fingerprint
from glossweave.session import scratch_path, stored

#: Bits of the filter per fingerprint, bits a fingerprint sets, and words in a row of the filter.
BITS_PER_KEY, MARKS, ROW_WORDS = 16, 5, 4096
#: A filter up to this many bytes is sent to every executor; beyond, lookups go without one.
BROADCAST_BYTES = 64 << 20


def write_memory(tm: DataFrame, buckets: int, name: str | None = None, path: str | None = None) -> str:
    """Store (fp, target, engine) in buckets by fingerprint; returns the table's name.

    Rows are dealt by fingerprint first, so each bucket is one sorted file.  For joins
    without a shuffle of the memory ``buckets`` must not be below
    ``spark.sql.shuffle.partitions``.  The files go to ``path``, or below the shared folder.
    """
    name = name or f"memory_{uuid.uuid4().hex}"
    (
        tm.select("fp", "target", "engine")
        .repartition(buckets, "fp")
        .write.format("parquet")
        .bucketBy(buckets, "fp")
        .sortBy("fp")
        .option("path", path or scratch_path(tm.sparkSession, "memory"))
        .saveAsTable(name)
    )
    return name


def _place(fp: Column, words: Column) -> tuple[Column, Column]:
    """The word of a fingerprint, and the bits it sets there."""
    first, second = F.xxhash64(fp), F.xxhash64(F.lit(1), fp)
    mask = F.lit(0).cast("long")
    for i in range(MARKS):
        bit = F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(first, words), mask


def build_filter(tm: DataFrame) -> DataFrame:
    """The Bloom filter of a memory's fingerprints: (block, words, bits array<long>), stored.

    All bits of a fingerprint lie in one 64-bit word, so a probe reads one word; with 16
    bits a key about 1 in 100 unknown fingerprints passes.  Words are combined on the map
    side before they are shuffled.
    """
    spark = tm.sparkSession
    n = max(1, tm.count())
    words = -(-n * BITS_PER_KEY // 64 // ROW_WORDS) * ROW_WORDS
    word, mask = _place(F.col("fp"), F.lit(words))
    marked = tm.filter(F.col("fp").isNotNull()).groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits"))
    every = spark.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    block = F.floor(F.col("word") / ROW_WORDS).cast("long")
    rows = (
        every.unionByName(marked)
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .groupBy(block.alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("row"))
    )
    return stored(rows.select("block", F.lit(words).alias("words"), F.col("row.bits").alias("bits")), "filter")


def probe(segments: DataFrame, bloom: DataFrame, fp: str = "fp") -> DataFrame:
    """Add ``_maybe``: false where the filter knows that the fingerprint is not in the memory.

    Without a filter, or if it is larger than ``BROADCAST_BYTES``, every row is a maybe.
    """
    head = bloom.select("words").first()
    if head is None or head["words"] * 8 > BROADCAST_BYTES:
        return segments.withColumn("_maybe", F.col(fp).isNotNull())
    word, mask = _place(F.col(fp), F.lit(head["words"]))
    placed = segments.withColumns({"_word": word, "_mask": mask})
    blocks = F.broadcast(bloom.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")))
    met = placed.join(blocks, F.floor(F.col("_word") / ROW_WORDS) == F.col("_block"), "left")
    found = F.get("_bits", F.pmod(F.col("_word"), F.lit(ROW_WORDS)).cast("int"))
    maybe = found.bitwiseAND(F.col("_mask")) == F.col("_mask")
    return met.withColumn("_maybe", F.coalesce(maybe, F.lit(False))).drop("_word", "_mask", "_block", "_bits")


def tm_lookup_large(spark: SparkSession, segments: DataFrame, memory: str, bloom: DataFrame) -> DataFrame:
    """The rows of ``tm_lookup``: segments with fp, target and engine, null on a miss.

    ``memory`` names a table of ``write_memory``, ``bloom`` is its filter.  The memory is read
    bucket by bucket without an exchange; of the segments only those are shuffled that
    the filter lets pass.
    """
    keyed = probe(segments.withColumn("fp", fingerprint(F.col("text"))), bloom)
    entries = spark.table(memory).select("fp", "target", "engine")
    kinds = dict(entries.dtypes)
    hits = keyed.filter("_maybe").drop("_maybe").join(entries, "fp", "left")
    misses = keyed.filter("NOT _maybe").drop("_maybe").withColumns(
        {c: F.lit(None).cast(kinds[c]) for c in ("target", "engine")}
    )
    return hits.unionByName(misses)
