"""The operators of this folder on the given tables, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossweave.llm import html_text, language, licenses, personal_data, url_filter
from glossweave.llm.common import table
from glossweave.llm.decontaminate import contaminated
from glossweave.llm.exact_dedup import exact_dedup
from glossweave.llm.fill_middle import fill_in_middle_digest
from glossweave.llm.hyperminhash import similarity_groups
from glossweave.llm.mixing import mix
from glossweave.llm.quality import quality_scores
from glossweave.llm.simhash import simhash_groups
from glossweave.llm.turn_trie import conversation_trie

Query = Callable[[SparkSession, str], DataFrame]
_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _remainder(n: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def quality_fold() -> Column:
    """Rows of ``labels`` the quality classifier may learn from."""
    return _remainder(5) != 0


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the texts outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(_remainder(4) != 2))
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget, one row per item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans and discovered ones."""
    return personal_data.digest(personal_data.find_personal_data(table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken when sources are mixed to their targets."""
    return mix(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels outside the held-out fold."""
    scored = quality_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=quality_fold()
    )
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in two bits or fewer."""
    return simhash_groups(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in every document that names one."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id of each stays."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are alike by 0.8 or more."""
    return similarity_groups(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at two drawn boundaries and reordered to fill in its middle."""
    return fill_in_middle_digest(table(spark, sf_dir, "documents"))


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _url_sql() -> str:
    def count(terms: tuple[str, ...]) -> str:
        return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT" for t in terms)

    rules = ", ".join(f"({_text(h)}, {_text(p)}, {_text(v)})" for h, p, v in url_filter.RULES)
    return f"""
        WITH parsed AS (
          SELECT page_id, translate(coalesce(url, ''), {_A_TO_Z}) AS u,
            translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_A_TO_Z}) AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        counted AS (
          SELECT *, {count(url_filter.STRICT)} AS n_strict, {count(url_filter.SOFT)} AS n_soft FROM parsed),
        rules(h, p, v) AS (VALUES {rules}),
        best AS (
          SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
          FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
        SELECT page_id, host, path, rule,
          coalesce(v, CASE WHEN n_strict > 0 OR n_soft >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END)
            AS verdict, n_strict::INT AS n_strict, n_soft::INT AS n_soft
        FROM counted LEFT JOIN best USING (page_id)"""


def _license_sql() -> str:
    known = ", ".join(f"({_text(s)}, {i})" for s, i in licenses.known_sentences().items())
    rules = ", ".join(f"({_text(n)}, {_text(p)})" for n, p in licenses.sequences())
    return f"""
        WITH cut AS (
          SELECT doc_id, regexp_split_to_array(coalesce(text, ''), {_text(licenses.SPLIT)}) AS parts
          FROM documents),
        raw AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS at_part FROM cut),
        parts AS (
          SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY at_part) - 1 AS pos
          FROM (SELECT doc_id, at_part, lower(trim(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g'))) AS s FROM raw)
          WHERE s <> ''),
        known(s, id) AS (VALUES {known}),
        written AS (
          SELECT doc_id, ',' || string_agg(id::VARCHAR || ',', '' ORDER BY pos) AS w, min(pos) AS pos
          FROM parts JOIN known USING (s) GROUP BY 1),
        rules(license, pattern) AS (VALUES {rules})
        SELECT doc_id, license, count(*)::INT AS n_rules, min(pos)::INT AS first_sentence
        FROM written JOIN rules ON regexp_matches(w, pattern) GROUP BY 1, 2"""


ORACLES = {
    "op5_url_filter": _url_sql(),
    "op8_licenses": _license_sql(),
    "op10_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), {_A_TO_Z}) AS t FROM documents)
        WINDOW g AS (PARTITION BY t)""",
    "op11_hyperminhash": f"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
        sets AS MATERIALIZED (
          SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w
            ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
        items AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        links AS MATERIALIZED (
          SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        reach(doc_id, r) AS (
          SELECT doc_id, doc_id FROM sets
          UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
        SELECT sets.doc_id, len(s) AS n_shingles, c AS component_id, sets.doc_id = c AS kept
        FROM sets JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1) USING (doc_id)""",
    "op12_fill_middle": f"""
        WITH t AS (
          SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
            {", ".join(f"('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))}
          FROM documents),
        cut AS (
          SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
        parts AS (
          SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1) AS s FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
          CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
            ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
          sha256(text) AS restored_sha256 FROM parts""",
    "op13_turn_trie": """
        WITH heads AS (
          SELECT c, xor(4294967295, list_reduce(
              list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
              lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % 6 AS h
          FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)),
        own AS (
          SELECT conv_id AS c, length(coalesce(text, '')) AS n,
            substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS tid,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tid) AS pos
          FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT DISTINCT c, c - c % 100 AS base, h FROM own JOIN heads USING (c)),
        rebuilt AS (
          SELECT c, pos, tid, n FROM own JOIN heads USING (c) WHERE pos > h
          UNION ALL SELECT ids.c, own.pos, tid, n FROM ids JOIN own ON own.c = ids.base AND own.pos <= ids.h),
        seqs AS (
          SELECT ids.c, coalesce(s, []) AS s, coalesce(lens, []) AS lens FROM ids LEFT JOIN (
            SELECT c, list(tid ORDER BY pos) AS s, list(n ORDER BY pos) AS lens FROM rebuilt GROUP BY 1) USING (c)),
        prefixes AS (
          SELECT c, d, list_aggregate(s[1:d], 'string_agg', ',') AS path, d = len(s) AS ends, coalesce(lens[d], 0) AS n,
            CASE WHEN d > 0 THEN coalesce(list_aggregate(s[1:d - 1], 'string_agg', ','), '') END AS up
          FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
        nodes AS (
          SELECT d, coalesce(path, '') AS path, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
            sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
          FROM prefixes GROUP BY 1, 2),
        kids AS (SELECT d - 1 AS d, up AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
        full_nodes AS (SELECT *, coalesce(n_children, 0) AS k, (n_convs - 1) * n AS own FROM nodes LEFT JOIN kids USING (d, path)),
        sums AS (
          SELECT p.d, coalesce(p.path, '') AS path, sum(own) AS saved, count(*) FILTER (k = 0) AS leaves
          FROM full_nodes f JOIN seqs ON seqs.c = f.conv_id
            JOIN prefixes p ON p.c = f.conv_id AND p.d <= f.d GROUP BY 1, 2)
        SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.k AS n_children,
          leaves AS n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256
        FROM full_nodes f JOIN sums USING (d, path) LEFT JOIN nodes u ON u.d = f.d - 1 AND u.path = f.up""",
}

QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_language, op2_decontamination, op3_personal_data, op4_mixing, op5_url_filter, op6_quality, op7_simhash, op8_licenses, op9_html_text, op10_exact_dedup, op11_hyperminhash, op12_fill_middle, op13_turn_trie)}
