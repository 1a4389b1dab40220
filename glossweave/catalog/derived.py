"""Inputs derived from the given tables, once as DataFrames and once as SQL.

The SQL forms are named table expressions; ``with_views`` puts the ones a check
needs, in dependency order, in front of its SELECT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossweave.functions import text as tx
from glossweave.operators.ingest import extract_blocks
from glossweave.operators.terms import HONORIFICS
from glossweave.plans.scale import spread
from glossweave.sources import read_pages

START = "2024-01-01 00:00:00"
MONTH_SECONDS = 30 * 24 * 3600


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def sql_replace(expr: str, pattern: str, replacement: str) -> str:
    """regexp_replace of all matches, with Spark's $1 written as \\1."""
    repl = sql_text(replacement.replace("$1", "\\1")) if "\n" not in replacement else "chr(10)"
    return f"regexp_replace({expr}, {sql_text(pattern)}, {repl}, 'g')"


def sql_entities(expr: str) -> str:
    for name, char in tx.ENTITIES:
        expr = f"replace({expr}, {sql_text(name)}, {sql_text(char)})"
    return expr


def sql_fold(expr: str) -> str:
    return f"trim({sql_replace(expr, tx.SPACE_PATTERN, ' ')})"


def sql_fingerprint(expr: str) -> str:
    return f"sha256(lower({sql_fold(expr)}))"


def sql_words(expr: str) -> str:
    unspaced = tx.UNSPACED_PATTERN.replace(r"\p{Is", r"\p{")
    spaced = f"regexp_replace(lower({expr}), {sql_text(unspaced)}, ' \\0 ', 'g')"
    return f"regexp_extract_all({spaced}, {sql_text(tx.WORD_PATTERN)})"


def sql_micros(expr: str) -> str:
    return f"epoch_us({expr})"


def _sql_visible(expr: str) -> str:
    h = sql_replace(expr, tx.HIDDEN_PATTERN, "")
    h = sql_replace(h, r"[ \t\r\n\f]+", " ")
    h = sql_replace(h, tx.BLOCK_PATTERN, "\n")
    h = sql_entities(sql_replace(h, tx.TAG_PATTERN, ""))
    h = sql_replace(sql_replace(h, " +", " "), " ?\\n[ \\n]*", "\n")
    return f"list_filter(string_split(trim({h}, ' ' || chr(10)), chr(10)), lambda t: t <> '')"


_HONORIFIC_SQL = "[" + ", ".join(sql_text(h) for h in HONORIFICS) + "]"

# name -> (views it reads, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "blocks": (
        (),
        f"""SELECT page_id, unnest(range(0, len(b))) AS pos, unnest(b) AS text
            FROM (SELECT page_id, {_sql_visible('html')} AS b FROM pages)""",
    ),
    "blocks_v2": (
        ("blocks",),
        """SELECT page_id, pos, CASE WHEN pos % 11 = 0 THEN text || '!' ELSE text END AS text
           FROM blocks JOIN pages USING (page_id) WHERE url NOT LIKE '%://blog.%'
           UNION ALL SELECT page_id, 100000, 'new' FROM pages WHERE url LIKE '%?%'""",
    ),
    "segments": (
        (),
        """SELECT doc_id, pos, text, lang FROM (
             SELECT doc_id, lang, unnest(range(0, len(p))) AS pos, unnest(p) AS text
             FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS p FROM documents))
           WHERE trim(text) <> ''""",
    ),
    "turns": ((), "SELECT conv_id AS work, turn AS pos, text FROM conversations"),
    "tm": (
        ("blocks",),
        f"""SELECT {sql_fingerprint('b.text')} AS fp, min(b.text) AS source,
              'T:' || min(b.text) AS target, 1 AS engine,
              TIMESTAMP '{START}' + to_seconds(max(b.page_id) * 7919 % {MONTH_SECONDS}) AS ts,
              count(*) AS uses
            FROM blocks b JOIN pages p USING (page_id)
            WHERE p.url LIKE 'https://%' GROUP BY 1""",
    ),
    "candidates": (
        ("segments",),
        """SELECT doc_id, pos, engine,
             CASE engine WHEN 0 THEN 'A:' || text
                         WHEN 1 THEN (CASE WHEN pos % 2 = 0 THEN 'A:' ELSE 'B:' END) || text
                         ELSE (CASE WHEN pos % 3 = 0 THEN 'B:' ELSE 'C:' END) || text END AS target,
             (doc_id * 31 + pos * 17 + engine * 7) % 100 AS score
           FROM segments, (VALUES (0), (1), (2)) e(engine)""",
    ),
    "regions": (
        (),
        """SELECT event_id AS id, user_id AS page, x0, y0,
             x0 + 20 + event_id * 13 % 120 AS x1, y0 + 20 + event_id * 7 % 90 AS y1,
             event_id * 53 % 101 AS score, event_type
           FROM (SELECT *, event_id * 37 % 800 AS x0, event_id * 91 % 1200 AS y0 FROM events)""",
    ),
    "panels": (
        (),
        """SELECT page, panel_no, panel_no % 2 * 470 AS x0, panel_no // 2 * 437 AS y0,
             panel_no % 2 * 470 + 470 AS x1, panel_no // 2 * 437 + 437 AS y1
           FROM (SELECT DISTINCT user_id AS page FROM events), range(0, 6) r(panel_no)""",
    ),
    "protected": (("regions",), "SELECT * FROM regions WHERE event_type = 'purchase'"),
    "placements": (
        ("regions",),
        """SELECT id, page, cand, x0 + dx AS x0, y0 + dy AS y0, x1 + dx AS x1, y1 + dy AS y1
           FROM regions, (VALUES (0, -40, -40), (1, -40, 40), (2, 40, -40), (3, 40, 40)) c(cand, dx, dy)
           WHERE event_type <> 'purchase'""",
    ),
    "mentions_text": (
        (),
        f"""SELECT p_partkey AS id,
              split_part(p_name, ' ', 1) || '-' || {_HONORIFIC_SQL}[p_partkey % 4 + 1] || ' met ' ||
              split_part(p_name, ' ', 2) || '-' || {_HONORIFIC_SQL}[p_size % 4 + 1] || '.' AS text
            FROM part""",
    ),
    "sfx_tokens": (
        (),
        """SELECT p_partkey AS id,
             split_part(p_name, ' ', -1) || repeat(right(p_name, 1), (p_partkey % 4)::INT) AS token
           FROM part""",
    ),
    "sfx": (
        (),
        """SELECT form, upper(form) AS translation FROM (
             SELECT DISTINCT array_to_string(list_filter(w, lambda c, i: i = 1 OR c <> w[i - 1]), '') AS form
             FROM (SELECT string_split(split_part(p_name, ' ', -1), '') AS w FROM part))
           QUALIFY form <> max(form) OVER ()""",
    ),
    "glossary": (
        (),
        f"""SELECT DISTINCT term, upper(term) AS gloss FROM (
              SELECT unnest({sql_words('text')}) AS term FROM benchmark) WHERE length(term) >= 3""",
    ),
    "catalogs": (
        (),
        """SELECT lang, 'k' || (doc_id // 4) AS key, min(source) AS value
           FROM documents GROUP BY 1, 2""",
    ),
    "settings": (
        (),
        """SELECT user_id, event_id % 3 AS device, event_type AS key,
             json_extract_string(props, '$.k') AS value, ts FROM events""",
    ),
    "consent": (
        (),
        """SELECT user_id, CASE event_type WHEN 'signup' THEN 'granted' ELSE 'revoked' END AS state, ts
           FROM events WHERE event_type IN ('signup', 'error')""",
    ),
    "subjects": ((), "SELECT * FROM events WHERE event_type NOT IN ('signup', 'error')"),
    "checksums": (
        (),
        """SELECT url AS path, CASE WHEN url LIKE '%?%' THEN sha256(html || 'x')
             ELSE sha256(html) END AS sha256
           FROM pages WHERE url NOT LIKE '%://m.%' UNION ALL SELECT 'unknown', sha256('unknown')""",
    ),
    "event_memory": (
        (),
        f"""SELECT {sql_fingerprint('props')} AS fp, min(props) AS source, 'T:' || min(props) AS target,
              1 AS engine FROM events WHERE event_type = 'purchase' AND value > 20 GROUP BY 1""",
    ),
}


def with_views(sql: str, *names: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in VIEWS[name][0]:
                visit(dep)
            order.append(name)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order)
    lead = sql.lstrip()
    if lead[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{lead[5:]}"
    return f"WITH {ctes}\n{lead}"


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return extract_blocks(read_pages(spark, sf))


def blocks_v2(spark: SparkSession, sf: str) -> DataFrame:
    """A later snapshot: blog pages are gone, some texts changed, pages with a query string grew."""
    pages = read_pages(spark, sf)
    kept = extract_blocks(pages.filter("url NOT LIKE '%://blog.%'")).withColumn(
        "text", F.expr("CASE WHEN pos % 11 = 0 THEN text || '!' ELSE text END")
    )
    added = pages.filter("url LIKE '%?%'").select(
        "page_id", F.lit(100000).alias("pos"), F.lit("new").alias("text")
    )
    return kept.unionByName(added)


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return (
        documents(spark, sf)
        .select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        .filter(F.trim("text") != "")
        .select("doc_id", "pos", "text", "lang")
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("work"), F.col("turn").alias("pos"), "text"
    )


def tm(spark: SparkSession, sf: str) -> DataFrame:
    """Memory built from the blocks of pages served over https."""
    pages = read_pages(spark, sf).filter(F.col("url").startswith("https://"))
    seconds = F.max("page_id") * 7919 % MONTH_SECONDS
    return (
        extract_blocks(pages)
        .groupBy(tx.fingerprint(F.col("text")).alias("fp"))
        .agg(
            F.min("text").alias("source"),
            F.concat(F.lit("T:"), F.min("text")).alias("target"),
            F.lit(1).alias("engine"),
            (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)).alias("ts"),
            F.count(F.lit(1)).alias("uses"),
        )
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return (
        segments(spark, sf)
        .withColumn("engine", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .select(
            "doc_id",
            "pos",
            "engine",
            F.expr(
                """CASE engine WHEN 0 THEN 'A:'
                     WHEN 1 THEN CASE WHEN pos % 2 = 0 THEN 'A:' ELSE 'B:' END
                     ELSE CASE WHEN pos % 3 = 0 THEN 'B:' ELSE 'C:' END END || text"""
            ).alias("target"),
            F.expr("(doc_id * 31 + pos * 17 + engine * 7) % 100").alias("score"),
        )
    )


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """One box per event; the user stands for the page."""
    return (
        table(spark, sf, "events")
        .select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("page"),
            F.expr("event_id * 37 % 800").alias("x0"),
            F.expr("event_id * 91 % 1200").alias("y0"),
            F.expr("event_id * 53 % 101").alias("score"),
            "event_type",
        )
        .withColumn("x1", F.expr("x0 + 20 + id * 13 % 120"))
        .withColumn("y1", F.expr("y0 + 20 + id * 7 % 90"))
    )


def panels(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "events").select(F.col("user_id").alias("page")).distinct()
    return pages.withColumn("panel_no", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(
        "page",
        "panel_no",
        F.expr("panel_no % 2 * 470").alias("x0"),
        F.expr("panel_no div 2 * 437").alias("y0"),
        F.expr("panel_no % 2 * 470 + 470").alias("x1"),
        F.expr("panel_no div 2 * 437 + 437").alias("y1"),
    )


def protected(spark: SparkSession, sf: str) -> DataFrame:
    return regions(spark, sf).filter("event_type = 'purchase'")


def placements(spark: SparkSession, sf: str) -> DataFrame:
    """Four shifted candidate boxes for every box that is not protected."""
    shifts = F.array(
        *[
            F.struct(F.lit(c).alias("cand"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
            for c, dx, dy in [(0, -40, -40), (1, -40, 40), (2, 40, -40), (3, 40, 40)]
        ]
    )
    return (
        regions(spark, sf)
        .filter("event_type != 'purchase'")
        .withColumn("_s", F.explode(shifts))
        .selectExpr(
            "id", "page", "_s.cand AS cand", "x0 + _s.dx AS x0", "y0 + _s.dy AS y0",
            "x1 + _s.dx AS x1", "y1 + _s.dy AS y1",
        )
    )


def mentions_text(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(h) for h in HONORIFICS])
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(
            F.split_part("p_name", F.lit(" "), F.lit(1)),
            F.lit("-"),
            F.get(names, (F.col("p_partkey") % 4).cast("int")),
            F.lit(" met "),
            F.split_part("p_name", F.lit(" "), F.lit(2)),
            F.lit("-"),
            F.get(names, F.col("p_size") % 4),
            F.lit("."),
        ).alias("text"),
    )


def sfx_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.expr(
            "substring_index(p_name, ' ', -1) || repeat(right(p_name, 1), cast(p_partkey % 4 AS int))"
        ).alias("token"),
    )


def sfx(spark: SparkSession, sf: str) -> DataFrame:
    """Forms seen in the part names; the highest is left out, to give misses."""
    forms = (
        table(spark, sf, "part")
        .select(tx.collapse_stretch(F.substring_index("p_name", " ", -1)).alias("form"))
        .distinct()
    )
    top = forms.agg(F.max("form")).scalar()
    return forms.filter(F.col("form") != top).withColumn("translation", F.upper("form"))


def glossary(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "benchmark")
        .select(F.explode(tx.words(F.col("text"))).alias("term"))
        .filter(F.length("term") >= 3)
        .distinct()
        .withColumn("gloss", F.upper("term"))
    )


def catalogs(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "documents")
        .groupBy("lang", F.concat(F.lit("k"), F.floor(F.col("doc_id") / 4)).alias("key"))
        .agg(F.min("source").alias("value"))
    )


def settings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "user_id",
        (F.col("event_id") % 3).alias("device"),
        F.col("event_type").alias("key"),
        F.get_json_object("props", "$.k").alias("value"),
        "ts",
    )


def consent(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .filter(F.col("event_type").isin("signup", "error"))
        .select(
            "user_id",
            F.when(F.col("event_type") == "signup", "granted").otherwise("revoked").alias("state"),
            "ts",
        )
    )


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter(~F.col("event_type").isin("signup", "error"))


def checksums(spark: SparkSession, sf: str) -> DataFrame:
    """Listed checksums: mobile pages are not listed, those with a query string changed since."""
    pages = read_pages(spark, sf)
    listed = pages.filter("url NOT LIKE '%://m.%'").select(
        F.col("url").alias("path"),
        F.expr("CASE WHEN url LIKE '%?%' THEN sha2(html || 'x', 256) ELSE sha2(html, 256) END").alias(
            "sha256"
        ),
    )
    unknown = spark.range(1).select(
        F.lit("unknown").alias("path"), F.sha2(F.lit("unknown"), 256).alias("sha256")
    )
    return listed.unionByName(unknown)


def event_memory(spark: SparkSession, sf: str) -> DataFrame:
    """Memory of the properties of purchases above 20; events look their own up in it."""
    return (
        table(spark, sf, "events")
        .filter("event_type = 'purchase' AND value > 20")
        .groupBy(tx.fingerprint(F.col("props")).alias("fp"))
        .agg(
            F.min("props").alias("source"),
            F.concat(F.lit("T:"), F.min("props")).alias("target"),
            F.lit(1).alias("engine"),
        )
    )


def with_close_ranks(
    found: DataFrame, rows: DataFrame, keys: list[str], probs: dict[str, float], accuracy: int = 10_000
) -> DataFrame:
    """Replace quantile columns by whether their rank is off by at most n / accuracy, plus one."""
    columns = list(probs)
    ranks = (
        rows.join(found.select(*keys, *columns), keys)
        .groupBy(*keys)
        .agg(
            F.count("value").alias("_n"),
            *[F.count_if(F.col("value") < F.col(c)).alias(f"_{c}_below") for c in columns],
            *[F.count_if(F.col("value") <= F.col(c)).alias(f"_{c}_upto") for c in columns],
        )
    )
    slack = F.col("_n") / accuracy + 1
    close = [
        (
            (F.col(f"_{c}_below") <= F.col("_n") * p + slack) & (F.col(f"_{c}_upto") >= F.col("_n") * p - slack)
        ).alias(f"{c}_close")
        for c, p in probs.items()
    ]
    return found.drop(*columns).join(ranks, keys).select(*[c for c in found.columns if c not in columns], *close)
