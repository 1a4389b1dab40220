"""File sources with explicit schemas, and the idempotent cache sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from glossweave.plans.scale import spread

PAGE_COLUMNS = ["page_id", "url", "html"]

_STRINGS = T.ArrayType(T.StringType())
_STRING_MAP = T.MapType(T.StringType(), T.StringType())

# Icons and policies are maps: their keys are data, so inference would turn them
# into a struct that differs from file to file.
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("manifest_version", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("permissions", _STRINGS),
        T.StructField("optional_permissions", _STRINGS),
        T.StructField("host_permissions", _STRINGS),
        T.StructField(
            "background",
            T.StructType(
                [
                    T.StructField("service_worker", T.StringType()),
                    T.StructField("type", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "content_scripts",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("matches", _STRINGS),
                        T.StructField("js", _STRINGS),
                        T.StructField("css", _STRINGS),
                        T.StructField("run_at", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "web_accessible_resources",
            T.ArrayType(
                T.StructType(
                    [T.StructField("resources", _STRINGS), T.StructField("matches", _STRINGS)]
                )
            ),
        ),
        T.StructField("content_security_policy", _STRING_MAP),
        T.StructField(
            "action",
            T.StructType(
                [
                    T.StructField("default_popup", T.StringType()),
                    T.StructField("default_icon", _STRING_MAP),
                ]
            ),
        ),
        T.StructField("icons", _STRING_MAP),
        T.StructField("options_page", T.StringType()),
        T.StructField("sandbox", T.StructType([T.StructField("pages", _STRINGS)])),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Page corpus (page_id, url, html); unused columns are pruned from the scan."""
    return spread(spark.read.parquet(f"{folder}/pages.parquet").select(*PAGE_COLUMNS))


def read_manifests(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Many extension manifests as one nested table with the file each came from.

    ``multiline`` reads one (pretty-printed) manifest per file; without it the
    files hold one manifest per line and large files can be split.
    """
    return (
        spark.read.schema(MANIFEST_SCHEMA)
        .option("multiLine", multiline)
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("manifest_path"))
    )


def read_catalogs(
    spark: SparkSession,
    path: str,
    lang_pattern: str = r"([A-Za-z_-]+)\.json$",
    whole_file: bool = True,
) -> DataFrame:
    """Per-language message files (one JSON object of strings) as (lang, key, value).

    The language is the first group of ``lang_pattern`` in the file path.  With
    ``whole_file`` off, each line is an object of its own.
    """
    raw = spark.read.text(path, wholetext=whole_file)
    parsed = raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), lang_pattern, 1).alias("lang"),
        F.from_json("value", _STRING_MAP).alias("_m"),
    )
    return parsed.select("lang", F.explode("_m").alias("key", "value"))


def read_assets(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Binary assets below ``path``: path, size in bytes and SHA-256 of the content."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    )


def read_event_stream(
    spark: SparkSession, folder: str, glob: str = "events*.parquet", max_files: int | None = 1000
) -> DataFrame:
    """Event stream over Parquet files; ``ts`` becomes a timestamp so it can carry a watermark.

    A batch takes at most ``max_files`` files, so a long backlog is worked off in many.
    """
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def write_cache(df: DataFrame, path: str, partition: str) -> None:
    """Replace exactly the partitions present in ``df``; writing twice changes nothing.

    Rows are gathered by partition value and rebalanced, so a small value is written by
    one task and one that holds most of the rows by as many as its size needs.
    """
    (
        df.hint("rebalance", F.col(partition))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
