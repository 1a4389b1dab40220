"""Queries for sources and sinks, and the audits of files they read.

Manifests, catalogs and assets are derived from the given tables, written to the
shared folder and read back through the source under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossweave.catalog import derived as d
from glossweave.catalog.registry import query
from glossweave.operators import privacy
from glossweave.session import scratch_path
from glossweave.sources import files as src, nested, ranges
from glossweave.streaming.sinks import append_result

ALLOWED = ["activeTab", "economy", "small", "storage"]
PAGES_PER_ASSET = 100


@query("SELECT page_id, url, html FROM pages")
def read_pages(spark: SparkSession, sf: str) -> DataFrame:
    return src.read_pages(spark, sf)


def part_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """One manifest per part, as JSON lines read back with the explicit schema."""
    fields = """
        cast(3 AS bigint) AS manifest_version,
        concat(p_name, ' ', p_partkey) AS name,
        concat('1.', p_size) AS version,
        array('activeTab', lower(p_type)) AS permissions,
        CASE WHEN p_size > 25 THEN array('nativeMessaging') ELSE array() END AS optional_permissions,
        CASE WHEN p_size < 10 THEN array('<all_urls>') END AS host_permissions,
        named_struct('service_worker', concat('core/', p_brand, '.js'), 'type', 'module') AS background,
        array(named_struct('js', array(concat('scan/', p_name, '-', p_size, '.js')),
                           'css', array(concat('ui/', p_type, '.css')))) AS content_scripts,
        array(named_struct('resources', array(concat('fonts/', p_brand, '/*'),
                                              concat('data/', p_type, '-*.bin')))) AS web_accessible_resources,
        CASE WHEN p_size >= 10 THEN named_struct('default_popup', 'ui/popup.html', 'default_icon',
          map('16', concat('icons/', p_size, '.png'))) END AS action,
        map('16', concat('icons/', p_size, '.png'), '48', 'icons/large.png') AS icons,
        'ui/options.html' AS options_page,
        named_struct('pages', array(concat('core/', p_type, '.html'))) AS sandbox"""
    path = scratch_path(spark, "manifests")
    d.table(spark, sf, "part").selectExpr(f"to_json(struct({fields})) AS value").write.text(path)
    return src.read_manifests(spark, path, multiline=False)


def part_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files that exist: some of those the manifests of the dearer parts refer to."""
    paths = """
        'ui/options.html',
        CASE WHEN p_size < 5 THEN concat('core/', p_brand, '.js') END,
        CASE WHEN p_retailprice > 950 THEN concat('scan/', p_name, '-', p_size, '.js') END,
        CASE WHEN p_size > 48 THEN concat('fonts/', p_brand, '/', p_size, '.woff') END,
        CASE WHEN p_type <> 'SMALL' THEN concat('data/', p_type, '-', p_size, '.bin') END,
        CASE WHEN p_retailprice > 1000 THEN concat('icons/', p_size, '.png') END"""
    return (
        d.table(spark, sf, "part")
        .selectExpr(f"explode(array({paths})) AS path")
        .filter(F.col("path").isNotNull())
        .distinct()
    )


@query(
    """SELECT p_name || ' ' || p_partkey AS name, 3 AS manifest_version, '1.' || p_size AS version,
         2 AS n_permissions, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS n_optional,
         CASE WHEN p_size < 10 THEN '<all_urls>' END AS host, 'core/' || p_brand || '.js' AS worker,
         'scan/' || p_name || '-' || p_size || '.js' AS script,
         CASE WHEN p_size >= 10 THEN 'icons/' || p_size || '.png' END AS popup_icon,
         'icons/' || p_size || '.png' AS icon, 'core/' || p_type || '.html' AS sandbox_page
       FROM part"""
)
def read_manifests(spark: SparkSession, sf: str) -> DataFrame:
    return part_manifests(spark, sf).select(
        "name",
        "manifest_version",
        "version",
        F.size("permissions").alias("n_permissions"),
        F.size("optional_permissions").alias("n_optional"),
        F.get("host_permissions", F.lit(0)).alias("host"),
        F.col("background.service_worker").alias("worker"),
        F.col("content_scripts")[0]["js"][0].alias("script"),
        F.col("action.default_icon")["16"].alias("popup_icon"),
        F.col("icons")["16"].alias("icon"),
        F.col("sandbox.pages")[0].alias("sandbox_page"),
    )


@query(d.with_views("SELECT lang, key, value FROM catalogs", "catalogs"))
def read_catalogs(spark: SparkSession, sf: str) -> DataFrame:
    entries = F.map_from_entries(F.collect_list(F.struct("key", "value")))
    path = scratch_path(spark, "catalogs")
    (
        d.catalogs(spark, sf)
        .groupBy("lang", F.pmod(F.hash("key"), F.lit(16)).alias("_b"))
        .agg(F.to_json(entries).alias("value"))
        .select("lang", "value")
        .write.partitionBy("lang")
        .text(path)
    )
    return src.read_catalogs(spark, path, lang_pattern=r"lang=([^/]+)/", whole_file=False)


@query(
    """WITH m AS (SELECT o_orderkey % 3 AS part, o_orderkey, o_orderpriority, o_totalprice, o_orderstatus FROM orders)
       SELECT 'l' || part AS lang, 'order.' || o_orderkey || '.' || k AS key,
         CASE k WHEN 'rank' THEN split_part(o_orderpriority, '-', 1) WHEN 'tags.0' THEN o_orderpriority WHEN 'tags.1' THEN o_orderstatus END AS value,
         false AS broken
       FROM m, (SELECT unnest(['rank', 'tags.0', 'tags.1', 'none']) AS k) WHERE o_orderkey % 50 <> 0
       UNION ALL SELECT 'l' || part, NULL, NULL, true FROM m WHERE o_orderkey % 50 = 0"""
)
def read_nested_catalogs(spark: SparkSession, sf: str) -> DataFrame:
    """Messages nested three deep, one order a line; every fiftieth line is cut off in the middle."""
    order = F.struct(
        F.split("o_orderpriority", "-")[0].alias("rank"), F.array("o_orderpriority", "o_orderstatus").alias("tags"), F.lit(None).alias("none")
    )
    line = F.to_json(
        F.struct(F.create_map(F.col("o_orderkey").cast("string"), order).alias("order")), {"ignoreNullFields": "false"}
    )
    cut = F.when(F.col("o_orderkey") % 50 == 0, F.substring(line, 1, 20)).otherwise(line)
    path = scratch_path(spark, "nested")
    rows = d.table(spark, sf, "orders").select(F.concat(F.lit("l"), (F.col("o_orderkey") % 3).cast("string")).alias("lang"), cut.alias("value"))
    rows.write.partitionBy("lang").text(path)
    found = nested.read_nested_catalogs(spark, path, r"lang=([^/]+)/", whole_file=False)
    return found.select("lang", "key", "value", F.col("corrupt").isNotNull().alias("broken"))


@query(
    f"""SELECT strlen(body) AS size, sha256(body) AS sha256 FROM (
          SELECT string_agg(html || chr(10), '' ORDER BY page_id) AS body FROM pages
          GROUP BY page_id // {PAGES_PER_ASSET})"""
)
def read_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Pages bundled a hundred to a file, so that a file's size does not grow with the table."""
    return src.read_assets(spark, _bundles(spark, sf), "*.txt").select("size", "sha256")


def _bundles(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "assets")
    (
        src.read_pages(spark, sf)
        .select("page_id", F.expr(f"page_id div {PAGES_PER_ASSET}").alias("bundle"), "html")
        .repartition("bundle")
        .sortWithinPartitions("bundle", "page_id")
        .select("bundle", "html")
        .write.partitionBy("bundle")
        .text(path)
    )
    return path


_RANGE, _FANOUT = 4096, 4


def _tree_sql(levels: int = 8) -> str:
    steps = "".join(
        f""", t{i + 1} AS (
              SELECT file, bytes, n_ranges, no // {_FANOUT} AS no, any_value(ceil(n / {_FANOUT})::BIGINT) AS n,
                CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY no)) ELSE any_value(h) END AS h
              FROM t{i} GROUP BY file, bytes, n_ranges, no // {_FANOUT})"""
        for i in range(levels)
    )
    return f"""WITH files AS (
          SELECT page_id // {PAGES_PER_ASSET} AS file, encode(string_agg(html || chr(10), '' ORDER BY page_id)) AS body FROM pages GROUP BY 1),
        sized AS (SELECT file, hex(body) AS hexed, octet_length(body) AS bytes, greatest(1, ceil(octet_length(body) / {_RANGE}))::BIGINT AS n_ranges FROM files),
        t0 AS (
          SELECT file, bytes, n_ranges, no, n_ranges AS n, sha256(unhex(substr(hexed, 2 * {_RANGE} * no + 1, 2 * {_RANGE}))) AS h
          FROM (SELECT *, unnest(range(n_ranges)) AS no FROM sized)){steps}
        SELECT bytes, n_ranges, h AS root FROM t{levels}"""


@query(_tree_sql())
def range_hash_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The same bundles in ranges of 4 KB, each read by itself, and the root over each file."""
    found = ranges.file_ranges(spark, _bundles(spark, sf), "*.txt", _RANGE)
    return ranges.hash_tree(ranges.hash_ranges(found), _FANOUT).select("bytes", "n_ranges", "root")


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def read_event_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = append_result(src.read_event_stream(spark, sf), "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    d.with_views(
        """SELECT doc_id, pos, CASE lang WHEN 'fr' THEN 'new: ' || text ELSE text END AS text, lang
           FROM segments""",
        "segments",
    )
)
def write_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Write by language, then replace the French partition only, twice."""
    path = scratch_path(spark, "cache")
    rows = d.segments(spark, sf)
    src.write_cache(rows, path, "lang")
    french = rows.filter("lang = 'fr'").withColumn("text", F.concat(F.lit("new: "), F.col("text")))
    src.write_cache(french, path, "lang")
    src.write_cache(french, path, "lang")
    return spark.read.parquet(path)


_ALLOWED = ", ".join(d.sql_text(a) for a in ALLOWED)


@query(
    f"""SELECT p_name || ' ' || p_partkey AS name, kind, permission FROM (
          SELECT p_name, p_partkey, 'required' AS kind, unnest(['activeTab', lower(p_type)]) AS permission FROM part
          UNION ALL SELECT p_name, p_partkey, 'optional', 'nativeMessaging' FROM part WHERE p_size > 25
          UNION ALL SELECT p_name, p_partkey, 'host', '<all_urls>' FROM part WHERE p_size < 10)
        WHERE permission NOT IN ({_ALLOWED})"""
)
def permission_audit(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.permission_audit(part_manifests(spark, sf), ALLOWED)


@query(
    """WITH files AS MATERIALIZED (SELECT DISTINCT path FROM (SELECT unnest([
           'ui/options.html',
           CASE WHEN p_size < 5 THEN 'core/' || p_brand || '.js' END,
           CASE WHEN p_retailprice > 950 THEN 'scan/' || p_name || '-' || p_size || '.js' END,
           CASE WHEN p_size > 48 THEN 'fonts/' || p_brand || '/' || p_size || '.woff' END,
           CASE WHEN p_type <> 'SMALL' THEN 'data/' || p_type || '-' || p_size || '.bin' END,
           CASE WHEN p_retailprice > 1000 THEN 'icons/' || p_size || '.png' END]) AS path FROM part)
         WHERE path IS NOT NULL),
       refs AS (SELECT DISTINCT name, r[1] AS kind, r[2] AS path FROM (
         SELECT p_name || ' ' || p_partkey AS name, unnest([
           ['background', 'core/' || p_brand || '.js'],
           ['script', 'scan/' || p_name || '-' || p_size || '.js'],
           ['style', 'ui/' || p_type || '.css'],
           ['resource', 'fonts/' || p_brand || '/*'],
           ['resource', 'data/' || p_type || '-*.bin'],
           CASE WHEN p_size >= 10 THEN ['popup', 'ui/popup.html'] END,
           ['icon', 'icons/' || p_size || '.png'],
           ['icon', 'icons/large.png'],
           ['options', 'ui/options.html'],
           ['sandbox', 'core/' || p_type || '.html']]) AS r FROM part) WHERE r IS NOT NULL),
       found AS (SELECT DISTINCT w.path FROM (SELECT DISTINCT path FROM refs) w
                 JOIN files f ON f.path LIKE replace(w.path, '*', '%'))
       SELECT name, kind, path FROM refs WHERE path NOT IN (SELECT path FROM found)"""
)
def manifest_path_audit(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.manifest_path_audit(part_manifests(spark, sf), part_files(spark, sf))
