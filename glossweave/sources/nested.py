"""JSON files of unknown shape: parsed to VARIANT, broken ones kept apart.

A message file may nest its messages, and a manifest may hold keys nobody has written a
schema for.  Such files are parsed once into a VARIANT column and taken apart level by level
into one row per leaf; what does not parse comes back as a row with its text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossweave.session import stored
from glossweave.sources.files import MANIFEST_SCHEMA


#: Levels of nesting that one pass takes apart.
LEVELS = 4


def read_json_leaves(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """One row per leaf of every JSON file or line: file, key, value, kind, corrupt.

    ``key`` is the way to the leaf, names and positions joined by dots (a dot inside a name
    is written ``\\.``); the top itself has the key ``""``.  ``value`` is the leaf as text, null
    for JSON's null, and ``kind`` its type as Spark names it.  An empty object or array is a
    leaf with a null value.  Text that is not JSON, or names a key twice, gives one row with
    the text in ``corrupt`` and all else null, so it can be counted and looked at.  Files are
    read and parsed once and taken apart ``LEVELS`` levels deep in one pass; what is still an
    object or array then goes on in another.
    """
    return _leaves(spark, path, whole_file, F.col("file"))


def _leaves(spark: SparkSession, path: str, whole_file: bool, source: Column) -> DataFrame:
    """The leaves with ``source``, an expression of the column ``file`` named once for each text, not for each leaf."""
    raw = spark.read.text(path, wholetext=whole_file).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = raw.filter(F.trim("value") != "").select(source, "value", F.try_parse_json("value").alias("v"))
    name, empty = parsed.columns[0], F.lit(None).cast("string")
    corrupt = F.when(F.col("v").isNull(), F.col("value"))
    live = parsed.select(name, F.when(F.col("v").isNotNull(), F.lit("")).alias("key"), "v", corrupt.alias("corrupt"))
    leaves = []
    while True:
        for _ in range(LEVELS):
            live = _opened(spark, live, name)
        text, kind = F.col("v").cast("string"), F.col("kind")
        is_open = kind.rlike("^(OBJECT|ARRAY)<") & ~text.isin("{}", "[]")
        value = F.when(kind.rlike("^(OBJECT|ARRAY)<|^VOID$"), empty).otherwise(text)
        typed = live.withColumn("kind", F.schema_of_variant("v")).withColumn("_open", F.coalesce(is_open, F.lit(False)))
        found = stored(
            typed.select(name, "key", value.alias("value"), "kind", "corrupt", F.when(F.col("_open"), F.col("v")).alias("v")),
            "json",
        )
        leaves.append(found.filter("v IS NULL").drop("v"))
        live = found.filter("v IS NOT NULL").select(name, "key", "v", "corrupt")
        if live.isEmpty():
            return reduce(DataFrame.unionByName, leaves)


def _opened(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Objects and arrays replaced by what they hold; leaves, empty ones and broken texts as they are."""
    inner = spark.tvf.variant_explode_outer(F.col("v").outer()).toDF("_pos", "_name", "_inner")
    held = F.col("_pos").isNotNull()
    key = F.when(held, _join("key", F.coalesce("_name", F.col("_pos").cast("string")))).otherwise(F.col("key"))
    v = F.when(held, F.col("_inner")).otherwise(F.col("v"))
    return rows.lateralJoin(inner).select(name, key.alias("key"), v.alias("v"), "corrupt")


def _join(key: str, name: Column) -> Column:
    escaped = F.replace(name, F.lit("."), F.lit("\\."))
    return F.when(F.col(key) == "", escaped).otherwise(F.concat(key, F.lit("."), escaped))


def read_nested_catalogs(
    spark: SparkSession, path: str, lang_pattern: str = r"([A-Za-z_-]+)\.json$", whole_file: bool = True
) -> DataFrame:
    """Message files with nested messages as (lang, key, value, corrupt); see ``read_json_leaves``."""
    lang = F.regexp_extract("file", lang_pattern, 1).alias("lang")
    return _leaves(spark, path, whole_file, lang).select("lang", "key", "value", "corrupt")


def unknown_manifest_keys(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Leaves of manifests below keys that ``MANIFEST_SCHEMA`` does not name, and broken files."""
    known = MANIFEST_SCHEMA.fieldNames()
    top = F.split("key", r"(?<!\\)\.", 2)[0]
    return read_json_leaves(spark, path, whole_file).filter(F.col("corrupt").isNotNull() | ~top.isin(*known))
