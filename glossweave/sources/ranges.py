"""Files of any size by byte ranges, and hash trees over the ranges.

``binaryFile`` reads a file as one value, which Spark limits to 2 GB.  Here only names and
sizes are listed, each file is cut into ranges, and every range is read and hashed by a
task of its own.  A tree over the hashes gives each file one root; two files differ
exactly where their ranges' hashes do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossweave.session import stored

RANGE_BYTES = 64 << 20
#: Bytes read at a time.
PIECE = 4 << 20
FANOUT = 64

Opener = Callable[[str], BinaryIO]


def open_uri(path: str) -> BinaryIO:
    """Open a file by its URI for reading at any place (local, HDFS, S3 or GCS through Arrow)."""
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def file_ranges(spark: SparkSession, path: str, glob: str = "*", size: int = RANGE_BYTES) -> DataFrame:
    """(path, bytes, n_ranges, no, start, length) of all files below ``path``; nothing is read.

    Empty files are not listed, as Spark leaves them out.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.col("length").alias("bytes"))
    )
    count = F.ceil(F.col("bytes") / size).cast("long")
    start = F.col("no") * size
    return (
        files.withColumn("n_ranges", count)
        .withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_ranges") - 1)))
        .select("path", "bytes", "n_ranges", "no", start.alias("start"), F.least(F.lit(size), F.col("bytes") - start).alias("length"))
    )


def hash_ranges(ranges: DataFrame, opener: Opener = open_uri, tasks: int | None = None) -> DataFrame:
    """The ranges with the ``sha256`` of their bytes, each read by one task in small pieces.

    ``opener`` opens a path on an executor.  Ranges are dealt evenly over ``tasks`` (by
    default the shuffle partitions), so one large file is read by all of them.
    """
    spark = ranges.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    picked = ranges.select("path", "bytes", "n_ranges", "no", "start", "length")
    names = [*picked.columns, "sha256"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, start, left in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length"))):
                digest = hashlib.sha256()
                with opener(path) as file:
                    file.seek(start)
                    while left > 0:
                        piece = file.read(min(PIECE, left))
                        if not piece:
                            raise EOFError(f"{path} became shorter while it was read")
                        digest.update(piece)
                        left -= len(piece)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=names)

    schema = picked.schema.add("sha256", "string")
    return picked.repartition(tasks, F.xxhash64("path", "no")).mapInArrow(read, schema)


def hash_tree(hashed: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(path, bytes, n_ranges, root) of every file.

    Up to ``fanout`` neighbouring hashes become one, the SHA-256 of their hexadecimal forms in
    order, until a file has a single one; a file of one range has that range's hash.  No
    task holds more than ``fanout`` hashes of a file, and the levels grow with the logarithm
    of the longest file.
    """
    level = stored(hashed.select("path", "bytes", "n_ranges", "no", F.col("n_ranges").alias("_n"), "sha256"), "tree")
    while not level.filter("_n > 1").isEmpty():
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("no", "sha256"))), lambda x: x["sha256"])
        up = level.groupBy("path", "bytes", "n_ranges", "_n", F.floor(F.col("no") / fanout).alias("_up")).agg(ordered.alias("_h"))
        joined = F.when(F.col("_n") > 1, F.sha2(F.array_join("_h", ""), 256)).otherwise(F.col("_h")[0])
        level = stored(
            up.select("path", "bytes", "n_ranges", F.col("_up").alias("no"), F.ceil(F.col("_n") / fanout).alias("_n"), joined.alias("sha256")),
            "tree",
        )
    return level.select("path", "bytes", "n_ranges", F.col("sha256").alias("root"))


def changed_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ranges that differ between two tables of ``hash_ranges``: path, no, start, length, status.

    Only ranges of files whose roots differ need to be given.  ``status`` is changed, missing
    or extra; start and length are those of ``after``, or of ``before`` where it is missing.
    """
    keys = ["path", "no"]
    a = before.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in ("start", "length", "sha256")])
    b = after.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in ("start", "length", "sha256")])
    met = a.join(b, keys, "full_outer").filter(~F.col("_a_sha256").eqNullSafe(F.col("_b_sha256")))
    status = F.when(F.col("_b_sha256").isNull(), "missing").when(F.col("_a_sha256").isNull(), "extra").otherwise("changed")
    return met.select(
        *keys, F.coalesce("_b_start", "_a_start").alias("start"), F.coalesce("_b_length", "_a_length").alias("length"), status.alias("status")
    )
