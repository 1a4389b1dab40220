"""Queries for page ingest and text preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossweave.catalog import derived as d
from glossweave.catalog.registry import query
from glossweave.functions import text as tx
from glossweave.operators import ingest, prepare
from glossweave.operators.memory import tm_lookup
from glossweave.session import stored
from glossweave.sources import read_pages


@query(
    d.with_views(
        f"""SELECT b.page_id, count(*) AS n_blocks, count(t.fp) AS n_known,
              round(count(t.fp) / count(*), 6) AS known_share
            FROM blocks b LEFT JOIN tm t ON t.fp = {d.sql_fingerprint('b.text')} GROUP BY 1""",
        "tm",
    )
)
def page_memory_share(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each page is already in the translation memory?"""
    found = tm_lookup(d.blocks(spark, sf), d.tm(spark, sf))
    return (
        found.groupBy("page_id")
        .agg(F.count(F.lit(1)).alias("n_blocks"), F.count("target").alias("n_known"))
        .withColumn("known_share", F.round(F.col("n_known") / F.col("n_blocks"), 6))
    )


def _rule_sql() -> str:
    flags = ", ".join(
        f"CASE WHEN regexp_matches({col}, {d.sql_text(pat)}) THEN {d.sql_text(name)} END"
        for name, col, pat, _ in ingest.PAGE_RULES
    )
    score = " + ".join(
        f"CASE WHEN regexp_matches({col}, {d.sql_text(pat)}) THEN {weight} ELSE 0 END"
        for _, col, pat, weight in ingest.PAGE_RULES
    )
    return f"""SELECT * FROM (SELECT page_id, concat_ws(',', {flags}) AS rules, {score} AS score
               FROM pages) WHERE score > 0"""


@query(_rule_sql())
def detect_pages(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.detect_pages(read_pages(spark, sf))


_ADAPTERS = ", ".join(
    f"({d.sql_text(s)}, {d.sql_text(a)})" for s, a in ingest.SITE_ADAPTERS
)


@query(
    f"""SELECT page_id, host, coalesce(max_by(adapter, length(suffix)), 'generic') AS adapter
        FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages) p
        LEFT JOIN (VALUES {_ADAPTERS}) a(suffix, adapter)
          ON host = suffix OR ends_with(host, '.' || suffix)
        GROUP BY 1, 2"""
)
def route_adapter(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.route_adapter(read_pages(spark, sf), ingest.SITE_ADAPTERS)


@query(d.with_views("SELECT * FROM blocks", "blocks"))
def extract_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return d.blocks(spark, sf)


@query(
    d.with_views(
        """SELECT * FROM blocks WHERE text NOT IN (
             SELECT text FROM blocks GROUP BY text HAVING count(DISTINCT page_id) >= 3)""",
        "blocks",
    )
)
def drop_repeated_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.drop_repeated_blocks(d.blocks(spark, sf), 3)


@query(
    d.with_views(
        """SELECT page_id, pos,
             CASE WHEN o.text IS NULL THEN 'insert' WHEN n.text IS NULL THEN 'delete' ELSE 'update' END AS change,
             o.text AS old_text, n.text AS new_text
           FROM blocks o FULL JOIN blocks_v2 n USING (page_id, pos)
           WHERE o.text IS DISTINCT FROM n.text""",
        "blocks_v2",
    )
)
def changed_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.changed_blocks(d.blocks(spark, sf), d.blocks_v2(spark, sf))


def _sanitize_sql(expr: str) -> str:
    clean = d.sql_replace(d.sql_entities(expr), tx.CONTROL_PATTERN, "")
    wide = f"translate({clean}, {d.sql_text(tx.WIDE)}, {d.sql_text(tx.NARROW)})"
    return d.sql_fold(wide)


@query(f"SELECT page_id, {_sanitize_sql('html')} AS html FROM pages")
def sanitize_text(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.sanitize_text(read_pages(spark, sf).select("page_id", "html"), "html")


def _artifact_sql() -> tuple[str, str]:
    step = "SELECT doc_id, text FROM documents"
    hits: list[str] = []
    for i, (name, pattern, repl) in enumerate(prepare.ARTIFACT_RULES):
        kept = "".join(f", hit_{h}" for h in hits)
        step = (
            f"SELECT doc_id{kept}, regexp_matches(text, {d.sql_text(pattern)}) AS hit_{name}, "
            f"{d.sql_replace('text', pattern, repl)} AS text FROM ({step}) s{i}"
        )
        hits.append(name)
    counts = " UNION ALL ".join(
        f"SELECT '{h}' AS rule, count(*) FILTER (hit_{h}) AS n_rows FROM c" for h in hits
    )
    return step, f"WITH c AS MATERIALIZED ({step}) {counts}"


@query(_artifact_sql()[0])
def clean_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.clean_artifacts(d.documents(spark, sf).select("doc_id", "text"), "text")


@query(_artifact_sql()[1])
def artifact_hits(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.artifact_hits(d.documents(spark, sf), "text")


def _sentences_sql(source: str, key: str) -> str:
    return d.with_views(
        f"""SELECT {key}, sentence_no, min(pos) AS first_pos, count(*) AS n_parts,
              string_agg(text, ' ' ORDER BY pos) AS text
            FROM (SELECT *, sum(e) OVER (PARTITION BY {key} ORDER BY pos) - e AS sentence_no
                  FROM (SELECT *, regexp_matches(text, {d.sql_text(prepare.SENTENCE_END)})::BIGINT AS e
                        FROM {source}))
            GROUP BY 1, 2""",
        source,
    )


@query(_sentences_sql("segments", "doc_id"))
def restore_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.restore_sentences(d.segments(spark, sf))


@query(_sentences_sql("turns", "work"))
def restore_sentences_turns(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.restore_sentences(d.turns(spark, sf), key="work")


_CLASS_SQL = " ".join(
    f"WHEN regexp_matches(text, {d.sql_text(p)}) THEN {d.sql_text(n)}" for n, p in prepare.TEXT_RULES
)


@query(d.with_views(f"SELECT *, CASE {_CLASS_SQL} ELSE 'other' END AS text_class FROM segments", "segments"))
def classify_text(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.classify_text(d.segments(spark, sf))


@query("SELECT doc_id, true AS in_range, true AS agrees, true AS auc_ok FROM documents")
def train_text_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is scored and predicted by its score, and labels that were held out are
    ranked with an area under the curve of 0.9 or more."""
    labels = d.table(spark, sf, "labels")
    docs = stored(prepare.text_features(d.documents(spark, sf)), "features")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = prepare.train_text_classifier(docs, labels.filter(~held_out))
    scored = stored(prepare.score_text(model, docs), "scored")
    auc = prepare.ranking_quality(scored, labels.filter(held_out))
    return scored.select(
        "doc_id",
        F.col("score").between(0, 1).alias("in_range"),
        ((F.col("score") > 0.5).cast("int") == F.col("predicted")).alias("agrees"),
        F.lit(auc >= 0.9).alias("auc_ok"),
    )


def _script_sql() -> str:
    counts = ", ".join(
        f"len(regexp_extract_all(text, '\\p{{{prop}}}')) AS n_{n}" for n, prop, _ in prepare.SCRIPTS
    )
    top = "greatest(" + ", ".join(f"n_{n}" for n, _, _ in prepare.SCRIPTS) + ")"
    dominant = " ".join(f"WHEN n_{n} = t THEN '{n}'" for n, _, _ in prepare.SCRIPTS)
    bucket = " ".join(f"WHEN n_{n} = t THEN '{lang}'" for n, _, lang in prepare.SCRIPTS)
    balance = " - ".join(
        f"len(regexp_replace(text, '[^{letters}]', '', 'g'))" for letters in (prepare.SIMPLIFIED, prepare.TRADITIONAL)
    )
    return f"""SELECT * EXCLUDE (balance), CASE WHEN lang_bucket = 'zh' AND balance > 0 THEN 'simplified'
          WHEN lang_bucket = 'zh' AND balance < 0 THEN 'traditional' END AS zh_variant
        FROM (SELECT * EXCLUDE (t), CASE WHEN t = 0 THEN 'none' {dominant} END AS dominant_script,
          CASE WHEN t = 0 THEN 'none' WHEN n_hiragana + n_katakana > 0
                AND greatest(n_hiragana, n_katakana, n_han) = t THEN 'ja' {bucket} END AS lang_bucket
        FROM (SELECT *, {top} AS t FROM (SELECT doc_id, {counts}, {balance} AS balance FROM documents)))"""


@query(_script_sql())
def script_profile(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.script_profile(d.documents(spark, sf).select("doc_id", "text")).drop("text")


@query(
    """SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS n_copies
       FROM documents GROUP BY 1"""
)
def dedup_content(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.dedup_content(d.documents(spark, sf), "text", "doc_id")
