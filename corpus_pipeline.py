"""From raw documents to a training mix: each stage works on what the one before kept.

Stages: the quality classifier drops documents it rejects, exact dedup keeps one row of
each text, near dedup one of each SimHash component, decontamination drops documents
that hold a benchmark item, and mixing says how often each of the rest is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossweave.llm.common import table
from glossweave.llm.decontaminate import decontaminate
from glossweave.llm.exact_dedup import keep_one
from glossweave.llm.mixing import mix
from glossweave.llm.queries import quality_fold
from glossweave.llm.quality import keep_good
from glossweave.llm.simhash import keep_representatives
from glossweave.session import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"), learn_from=quality_fold())


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", benchmark),
    ("mixing", mixing),
]

#: SQL cannot fit the classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
