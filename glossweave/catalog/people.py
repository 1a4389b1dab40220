"""Queries for terminology, user state, privacy and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossweave.catalog import derived as d
from glossweave.catalog.registry import query
from glossweave.operators import privacy, rollups, state, terms
from glossweave.operators.terms import HONORIFICS
from glossweave.session import scratch_path, stored
from glossweave.sources import read_pages, write_cache

AS_OF = "2024-01-31"

_MENTION = r"\p{L}+(?:-\p{L}+)*-(?:" + "|".join(HONORIFICS) + r")\b"
_MENTIONS = f"""SELECT id, unnest(range(0, len(m))) AS mention_no,
    regexp_replace(unnest(m), '-[^-]*$', '') AS name, split_part(unnest(m), '-', -1) AS honorific
  FROM (SELECT id, regexp_extract_all(text, {d.sql_text(_MENTION)}) AS m FROM mentions_text)"""


@query(d.with_views(_MENTIONS, "mentions_text"))
def scan_honorifics(spark: SparkSession, sf: str) -> DataFrame:
    return terms.scan_honorifics(d.mentions_text(spark, sf))


@query(
    d.with_views(
        f"""SELECT name, string_agg(DISTINCT honorific, ',' ORDER BY honorific) AS honorifics,
              count(DISTINCT honorific) AS n_honorifics, count(*) AS n_mentions
            FROM ({_MENTIONS}) GROUP BY 1 HAVING count(DISTINCT honorific) > 1""",
        "mentions_text",
    )
)
def honorific_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return terms.honorific_consistency(scan_honorifics(spark, sf))


@query(
    d.with_views(
        """SELECT id, token, form, translation FROM (
             SELECT id, token,
               array_to_string(list_filter(w, lambda c, i: i = 1 OR c <> w[i - 1]), '') AS form
             FROM (SELECT id, token, string_split(lower(token), '') AS w FROM sfx_tokens))
           LEFT JOIN sfx USING (form)""",
        "sfx_tokens",
        "sfx",
    )
)
def sfx_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return terms.sfx_lookup(d.sfx_tokens(spark, sf), d.sfx(spark, sf))


@query(
    d.with_views(
        f"""SELECT doc_id, pos, count(*) AS n_words, count(g.term) AS n_hits,
              round(count(g.term) / count(*), 6) AS coverage
            FROM (SELECT doc_id, pos, unnest({d.sql_words('text')}) AS term FROM segments) w
            LEFT JOIN glossary g USING (term) GROUP BY 1, 2""",
        "segments",
        "glossary",
    )
)
def annotate_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.annotate_terms(d.segments(spark, sf), d.glossary(spark, sf))


@query(
    d.with_views(
        """WITH langs AS (SELECT DISTINCT lang FROM catalogs),
           base AS (SELECT key, value FROM catalogs WHERE lang = 'en')
           SELECT l.lang, b.key, 'missing' AS status, b.value AS fallback
           FROM langs l CROSS JOIN base b
           WHERE NOT EXISTS (SELECT 1 FROM catalogs c WHERE c.lang = l.lang AND c.key = b.key)
           UNION ALL
           SELECT lang, key, 'extra', NULL FROM catalogs
           WHERE lang <> 'en' AND key NOT IN (SELECT key FROM base)""",
        "catalogs",
    )
)
def catalog_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return terms.catalog_coverage(d.catalogs(spark, sf), "en")


@query(
    """SELECT * FROM (SELECT *, row_number() OVER (
         PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 5"""
)
def recent_history(spark: SparkSession, sf: str) -> DataFrame:
    return state.recent_history(d.table(spark, sf, "events"), 5)


SESSIONS_SQL = """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL {gap} AS session_end,
    count(*) AS n_events
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
        FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                               + INTERVAL {gap} THEN 0 ELSE 1 END AS fresh FROM events))
  GROUP BY user_id, s"""


@query(SESSIONS_SQL.format(gap="'2 hours'"))
def sessionize(spark: SparkSession, sf: str) -> DataFrame:
    return state.sessionize(d.table(spark, sf, "events"), 2 * 3600)


_DEFAULT_ROWS = ", ".join(
    f"({d.sql_text(k)}, {d.sql_text(v)})" for k, v in state.SETTING_DEFAULTS.items()
)


@query(
    d.with_views(
        f"""WITH u AS (SELECT user_id, key, max(row(ts, value))[2] AS value FROM settings
                       WHERE device = 0 GROUP BY 1, 2),
            v AS (SELECT user_id, device, key, max(row(ts, value))[2] AS value FROM settings
                  WHERE device <> 0 GROUP BY 1, 2, 3),
            dv AS (SELECT DISTINCT user_id, device FROM v),
            ks AS (SELECT user_id, device, key FROM dv, (VALUES {_DEFAULT_ROWS}) f(key, value)
                   UNION SELECT user_id, device, key FROM v
                   UNION SELECT user_id, device, key FROM dv JOIN u USING (user_id))
            SELECT user_id, device, key, coalesce(v.value, u.value, f.value) AS value,
              CASE WHEN v.value IS NOT NULL THEN 'device' WHEN u.value IS NOT NULL THEN 'user'
                   ELSE 'default' END AS layer
            FROM ks LEFT JOIN v USING (user_id, device, key) LEFT JOIN u USING (user_id, key)
            LEFT JOIN (VALUES {_DEFAULT_ROWS}) f(key, value) USING (key)""",
        "settings",
    )
)
def resolve_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Device 0 holds the account-wide settings, the others their own."""
    rows = d.settings(spark, sf)
    latest = F.max(F.struct("ts", "value"))["value"].alias("value")
    user = rows.filter("device = 0").groupBy("user_id", "key").agg(latest)
    device = rows.filter("device != 0").groupBy("user_id", "device", "key").agg(latest)
    return state.resolve_settings(state.SETTING_DEFAULTS, user, device)


@query(
    d.with_views(
        """WITH own AS (SELECT user_id, key, device, max(ts) AS ts, arg_max(value, ts) AS value
                        FROM settings GROUP BY 1, 2, 3)
           SELECT user_id, key, arg_max(value, ts) AS value, arg_max(device, ts) AS device,
             max(ts) AS ts, count(*) AS n_devices, count(DISTINCT value) AS n_values,
             count(DISTINCT value) > 1 AS conflict
           FROM own GROUP BY 1, 2""",
        "settings",
    )
)
def sync_merge(spark: SparkSession, sf: str) -> DataFrame:
    return state.sync_merge(d.settings(spark, sf))


CURRENT_SQL = """SELECT user_id, event_type AS state, ts AS since FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
  WHERE rn = 1"""


@query(CURRENT_SQL)
def current_state(spark: SparkSession, sf: str) -> DataFrame:
    return state.current_state(d.table(spark, sf, "events"))


_ROUTES = " ".join(f"WHEN {d.sql_text(k)} THEN {d.sql_text(v)}" for k, v in state.EVENT_ROUTES.items())
ROUTES_SQL = f"SELECT *, CASE event_type {_ROUTES} ELSE 'reject' END AS target FROM events"


@query(ROUTES_SQL)
def route_events(spark: SparkSession, sf: str) -> DataFrame:
    return state.route_events(d.table(spark, sf, "events"))


@query(
    """SELECT event_type, date_trunc('day', ts) AS window_start, count(*) AS n,
         round(sum(round(value * 100)::BIGINT) / 100 / count(*), 6) AS mean, max(value) AS max,
         round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
       FROM events GROUP BY 1, 2"""
)
def performance_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return state.performance_metrics(d.table(spark, sf, "events"), "1 day", exact=True)


@query(
    """SELECT event_type, date_trunc('day', ts) AS window_start, count(*) AS n,
         round(sum(round(value * 100)::BIGINT) / 100 / count(*), 6) AS mean, max(value) AS max,
         true AS p50_close, true AS p95_close
       FROM events GROUP BY 1, 2"""
)
def performance_metrics_approx(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate quantiles, judged by their ranks, at any size of a group."""
    events = d.table(spark, sf, "events")
    found = state.performance_metrics(events, "1 day")
    keyed = events.select("event_type", F.window("ts", "1 day")["start"].alias("window_start"), "value")
    return d.with_close_ranks(found, keyed, ["event_type", "window_start"], {"p50": 0.5, "p95": 0.95})


_TTL = (
    "CASE event_type "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in privacy.RETENTION_DAYS.items())
    + " END"
)
_EXPIRED = f"coalesce(ts::DATE < DATE '{AS_OF}' - ({_TTL})::INT, false)"


@query(f"SELECT * FROM events WHERE NOT {_EXPIRED}")
def apply_retention(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.apply_retention(d.table(spark, sf, "events"), privacy.RETENTION_DAYS, AS_OF)


@query(
    f"""SELECT event_type, count(*) FILTER (NOT {_EXPIRED}) AS n_kept,
          count(*) FILTER ({_EXPIRED}) AS n_expired, min(ts) AS oldest, {_TTL} AS ttl_days
        FROM events GROUP BY event_type"""
)
def retention_report(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.retention_report(d.table(spark, sf, "events"), privacy.RETENTION_DAYS, AS_OF)


@query(
    d.with_views(
        """SELECT s.* FROM subjects s ASOF JOIN consent c ON s.user_id = c.user_id AND s.ts >= c.ts
           WHERE c.state = 'granted'""",
        "subjects",
        "consent",
    )
)
def apply_consent(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.apply_consent(d.subjects(spark, sf), d.consent(spark, sf))


def _anonymize_sql() -> str:
    step, hits = "SELECT doc_id, text FROM documents", ""
    for i, (name, _, pattern, repl) in enumerate(privacy.REDACTIONS):
        step = (
            f"SELECT doc_id{hits}, len(regexp_extract_all(text, {d.sql_text(pattern)})) AS n_{name}, "
            f"{d.sql_replace('text', pattern, repl)} AS text FROM ({step}) s{i}"
        )
        hits += f", n_{name}"
    return f"SELECT * REPLACE (sha256('pepper:' || doc_id) AS doc_id) FROM ({step})"


@query(_anonymize_sql())
def anonymize(spark: SparkSession, sf: str) -> DataFrame:
    docs = d.documents(spark, sf).select("doc_id", "text")
    return privacy.anonymize(docs, "text", ["doc_id"], salt="pepper")


@query(
    """SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2
       HAVING count(*) < 12"""
)
def k_anonymity(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.k_anonymity(d.table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], 12)


@query(
    "SELECT c_custkey, c_name, c_mktsegment, true AS hidden FROM customer",
)
def protect_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Encrypt, check that the stored value differs from the plain one, decrypt."""
    key = F.lit("0123456789abcdef").cast("binary")
    plain = d.table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", F.col("c_name").alias("_plain")
    )
    hidden = privacy.protect_columns(plain, ["c_name", "c_mktsegment"], key).withColumn(
        "hidden", F.col("c_name") != F.col("_plain")
    )
    return privacy.reveal_columns(hidden, ["c_name", "c_mktsegment"], key).drop("_plain")


@query(
    d.with_views(
        """SELECT path, CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra'
                          WHEN actual = expected THEN 'matched' ELSE 'changed' END AS status,
             expected, actual
           FROM (SELECT url AS path, sha256(html) AS actual FROM pages)
           FULL JOIN (SELECT path, sha256 AS expected FROM checksums) USING (path)""",
        "checksums",
    )
)
def integrity_audit(spark: SparkSession, sf: str) -> DataFrame:
    files = read_pages(spark, sf).select(F.col("url").alias("path"), F.col("html").alias("content"))
    return privacy.integrity_audit(files, d.checksums(spark, sf))


# Hourly sketches are written once; days and months are merged from them alone.
_LEVELS = ("day", "month")


@query(
    " UNION ALL ".join(
        f"""SELECT '{level}' AS level, event_type, date_trunc('{level}', ts)::TIMESTAMP AS start, count(value) AS n,
              round(sum(round(value * 100)::BIGINT) / 100 / count(*), 6) AS mean, max(value) AS max,
              true AS p50_close, true AS p95_close, true AS users_close FROM events GROUP BY ALL"""
        for level in _LEVELS
    )
)
def metrics_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Days from stored hours and months from the days; ranks within 1 %, users within 4 %."""
    events = d.table(spark, sf, "events")
    path = scratch_path(spark, "hours")
    write_cache(rollups.sketch_metrics(events).withColumn("day", F.to_date("start")), path, "day")
    merged, found = spark.read.parquet(path).drop("day"), []
    for level in _LEVELS:
        merged = stored(rollups.merge_metrics(merged, level), level)
        start = F.date_trunc(level, "ts").alias("start")
        report = rollups.report_metrics(merged).withColumnRenamed("distinct", "users")
        close = d.with_close_ranks(
            report, events.select("event_type", start, "value"), ["event_type", "start"], {"p50": 0.5, "p95": 0.95}, 100
        )
        exact = events.groupBy("event_type", start).agg(F.count_distinct("user_id").alias("_users"))
        found.append(
            close.join(exact, ["event_type", "start"]).select(
                F.lit(level).alias("level"), "event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", "mean", "max",
                "p50_close", "p95_close", (F.abs(F.col("users") - F.col("_users")) <= F.col("_users") * 0.04).alias("users_close"),
            )
        )
    return found[0].unionByName(found[1])


_QUASI = ["o_totalprice", "o_custkey", "o_day"]


@query(
    """SELECT o_orderpriority, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents,
         true AS groups_ok, true AS inside, true AS narrow FROM orders GROUP BY 1"""
)
def anonymize_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Orders made 25-anonymous: all rows stay, inside their ranges, which are narrow on average."""
    orders = d.table(spark, sf, "orders").withColumn("o_day", F.unix_date(F.to_date("o_orderdate")))
    true_values = [F.col(q).alias(f"_{q}") for q in _QUASI]
    safe = stored(privacy.anonymize_groups(orders.select("*", *true_values), _QUASI, 25), "anonymous")
    report = privacy.information_loss(safe, _QUASI).first()
    inside = [(F.col(f"_{q}") >= F.col(f"{q}_low")) & (F.col(f"_{q}") <= F.col(f"{q}_high")) for q in _QUASI]
    sizes = safe.groupBy(*[f"{q}_{e}" for q in _QUASI for e in ("low", "high")]).agg(F.count(F.lit(1)).alias("_n"))
    smallest = sizes.agg(F.min("_n")).first()[0]
    return safe.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("_o_totalprice") * 100).cast("long")).alias("cents"),
        F.lit(smallest >= 25 and report["smallest_group"] >= 25).alias("groups_ok"),
        F.bool_and(inside[0] & inside[1] & inside[2]).alias("inside"),
        F.lit(report["loss"] < 0.25).alias("narrow"),
    )
