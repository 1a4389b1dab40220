"""Helpers the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Whitespace of the contracts: space and the characters 9 to 13.
BLANKS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def text_of(df: DataFrame, column: str) -> Column:
    """The column as text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Runs of characters other than the contract's whitespace; null has none."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    runs = F.length(F.regexp_replace(bare, rf"[^{BLANKS}]++[{BLANKS}]*+", "_"))
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(runs).cast("long")


def map_rows(
    df: DataFrame, columns: Sequence[Column], schema: str, rows: Callable[[Iterable[tuple]], Iterator[tuple]]
) -> DataFrame:
    """Apply a generator of tuples to each partition, in Arrow batches of bounded size.

    ``rows`` gets the partition's rows one at a time and yields output rows in the
    order of ``schema``; nothing but the batch in hand is kept.
    """
    picked = df.select(*columns)
    fields = picked.sparkSession.createDataFrame([], schema).schema.fields
    names = [f.name for f in fields]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        held: list[tuple] = []
        for row in rows(each()):
            held.append(row)
            if len(held) >= 4096:
                yield _batch(held, names, types)
                held = []
        if held:
            yield _batch(held, names, types)

    return picked.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    cols = [pa.array(list(c), type=t) for c, t in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(cols, names=names)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def share_below(key: Column, share: float) -> Column:
    """True for about ``share`` of the keys, the same keys at every run."""
    return F.pmod(F.xxhash64(F.lit("share"), key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def drop_rows(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``dropped``; a null key equals a null key."""
    gone = fresh(docs, "gone")
    ids = dropped.select(F.col(key).alias(gone)).distinct()
    return docs.join(ids, F.col(key).eqNullSafe(F.col(gone)), "left_anti")
