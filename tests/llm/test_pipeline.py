"""The pipeline and the corpus queries on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glossweave.llm import queries
from glossweave.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages_narrow_the_documents(spark):
    docs = table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == columns
        assert 0 < docs.count() <= n
        n = docs.count()
    assert {"doc_id", "taken"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns)
    assert corpus_pipeline.run(spark, SF).count() == n


def test_stages_take_an_empty_table(spark):
    none = table(spark, SF, "documents").filter("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_held_out_languages(spark):
    truth = table(spark, SF, "documents").select("doc_id", "lang")
    got = queries.op1_language(spark, SF).join(truth, "doc_id").filter("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right > 0.9


def test_held_out_quality(spark):
    small = SF.replace("0.001", "0.01")
    got = queries.op6_quality(spark, small).join(table(spark, small, "labels"), "doc_id").filter("held_out")
    good = [r["score"] for r in got.filter("quality = 1").collect()]
    bad = [r["score"] for r in got.filter("quality = 0").collect()]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.9
