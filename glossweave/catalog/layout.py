"""Queries for layout tables and style vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossweave.catalog import derived as d
from glossweave.catalog.registry import query
from glossweave.operators import layout, style

_OVERLAP = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
_SHARED = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"


def _area(t: str) -> str:
    return f"(({t}.x1 - {t}.x0) * ({t}.y1 - {t}.y0))"


_IOU = f"({_SHARED})::DOUBLE / ({_area('a')} + {_area('b')} - {_SHARED})"


@query(
    d.with_views(
        f"""SELECT a.page, a.id AS a_id, b.id AS b_id, {_area('a')} AS a_area, {_area('b')} AS b_area,
              {_SHARED} AS shared, round({_IOU}, 6) AS iou
            FROM regions a JOIN regions b ON a.page = b.page AND a.id < b.id AND {_OVERLAP}
            WHERE {_IOU} >= 0.05""",
        "regions",
    )
)
def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = layout.overlap_pairs(d.regions(spark, sf), 0.05)
    return pairs.withColumn("iou", F.round("iou", 6))


@query(
    d.with_views(
        f"""SELECT id, page, score FROM regions a WHERE NOT EXISTS (
              SELECT 1 FROM regions b WHERE a.page = b.page AND {_OVERLAP}
                AND (b.score > a.score OR (b.score = a.score AND b.id < a.id)) AND {_IOU} >= 0.2)""",
        "regions",
    )
)
def suppress_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return layout.suppress_overlaps(d.regions(spark, sf), 0.2).select("id", "page", "score")


_KEPT_IOU = _IOU.replace("a.", "k.").replace("b.", "r.")
_KEPT_OVERLAP = _OVERLAP.replace("a.", "k.").replace("b.", "r.")


@query(
    d.with_views(
        f"""WITH ranked AS MATERIALIZED (
              SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, id) AS rn FROM regions),
            step(page, rn, kept) AS (
              SELECT page, rn, [{{'id': id, 'score': score, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}]
              FROM ranked WHERE rn = 1
              UNION ALL
              SELECT r.page, r.rn, CASE WHEN len(list_filter(s.kept,
                  lambda k: {_KEPT_OVERLAP} AND {_KEPT_IOU} >= 0.2)) > 0 THEN s.kept
                ELSE list_append(s.kept, {{'id': r.id, 'score': r.score, 'x0': r.x0, 'y0': r.y0,
                                           'x1': r.x1, 'y1': r.y1}}) END
              FROM step s JOIN ranked r ON r.page = s.page AND r.rn = s.rn + 1)
            SELECT k.id AS id, page, k.score AS score
            FROM (SELECT page, unnest(arg_max(kept, rn)) AS k FROM step GROUP BY page)""",
        "regions",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def suppress_overlaps_greedy(spark: SparkSession, sf: str) -> DataFrame:
    kept = layout.suppress_overlaps(d.regions(spark, sf), 0.2, mode="greedy")
    return kept.select("id", "page", "score")


@query(
    d.with_views(
        f"""WITH edges AS MATERIALIZED (
              SELECT a.id AS u, b.id AS v FROM regions a JOIN regions b
              ON a.page = b.page AND a.id <> b.id AND {_OVERLAP}),
            reach(id, other) AS (
              SELECT id, id FROM regions
              UNION SELECT r.id, e.v FROM reach r JOIN edges e ON r.other = e.u),
            comp AS (SELECT id, min(other) AS block_id FROM reach GROUP BY 1)
            SELECT page, block_id, count(*) AS n_regions, min(x0) AS x0, min(y0) AS y0,
              max(x1) AS x1, max(y1) AS y1
            FROM regions JOIN comp USING (id) GROUP BY 1, 2""",
        "regions",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def merge_regions(spark: SparkSession, sf: str) -> DataFrame:
    return layout.merge_regions(d.regions(spark, sf))


_ASSIGNED = f"""SELECT r.page, r.id, r.x0, r.y0, r.x1, r.y1,
    arg_max(m.panel_no, m.shared * 100 - m.panel_no) AS panel_no, coalesce(max(m.shared), 0) AS shared
  FROM regions r LEFT JOIN (
    SELECT a.page, a.id, b.panel_no, {_SHARED} AS shared
    FROM regions a JOIN panels b ON a.page = b.page AND {_OVERLAP}) m ON r.page = m.page AND r.id = m.id
  GROUP BY ALL"""


@query(d.with_views(_ASSIGNED, "regions", "panels"))
def assign_to_panels(spark: SparkSession, sf: str) -> DataFrame:
    return layout.assign_to_panels(d.regions(spark, sf), d.panels(spark, sf))


def _order_sql(across: str) -> str:
    return d.with_views(
        f"""SELECT page, coalesce(panel_no, -1) AS panel_no, id, row_number() OVER (
              PARTITION BY page, coalesce(panel_no, -1) ORDER BY y0 // 60, {across}, y0, id) AS ord
            FROM ({_ASSIGNED})""",
        "regions",
        "panels",
    )


@query(_order_sql("-x1"))
def reading_order_rtl(spark: SparkSession, sf: str) -> DataFrame:
    return layout.reading_order(assign_to_panels(spark, sf), "rtl")


@query(_order_sql("x0"))
def reading_order_ltr(spark: SparkSession, sf: str) -> DataFrame:
    return layout.reading_order(assign_to_panels(spark, sf), "ltr")


def _cuts_sql(rounds: int = 5) -> str:
    """The cuts written out; five rounds are more than the nesting of the derived boxes."""

    def cut(name: str, source: str, axis: str, sign: str) -> str:
        w = f"PARTITION BY page, panel_no, path ORDER BY {axis}0, {axis}1, id"
        return f"""{name} AS (SELECT page, panel_no, id, x0, y0, x1, y1, path || [{sign}(sum(g) OVER ({w}))::BIGINT] AS path FROM (
              SELECT *, CASE WHEN {axis}0 >= max({axis}1) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                THEN 1 ELSE 0 END AS g FROM {source}))"""

    steps, at = [f"x0_ AS (SELECT page, coalesce(panel_no, -1) AS panel_no, id, x0, y0, x1, y1, []::BIGINT[] AS path FROM ({_ASSIGNED}))"], "x0_"
    for i in range(1, rounds + 1):
        steps += [cut(f"y{i}_", at, "y", ""), cut(f"x{i}_", f"y{i}_", "x", "-")]
        at = f"x{i}_"
    body = f"""SELECT page, panel_no, id,
          row_number() OVER (PARTITION BY page, panel_no ORDER BY path, y0, -x1, id) AS ord FROM {at}"""
    return d.with_views(f"WITH {', '.join(steps)} {body}", "regions", "panels")


@query(_cuts_sql())
def reading_order_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Right to left by recursive cuts at the gaps between boxes."""
    return layout.reading_order_cuts(assign_to_panels(spark, sf), "rtl")


_AUDIT = f"""SELECT a.page, a.id, a.cand, coalesce(sum(m.shared), 0)::BIGINT AS covered,
    count(m.shared) AS n_protected
  FROM placements a LEFT JOIN (
    SELECT a.page, a.id, a.cand, {_SHARED} AS shared
    FROM placements a JOIN protected b ON a.page = b.page AND {_OVERLAP}) m
  ON a.page = m.page AND a.id = m.id AND a.cand = m.cand GROUP BY ALL"""


@query(d.with_views(_AUDIT, "placements", "protected"))
def collision_audit(spark: SparkSession, sf: str) -> DataFrame:
    return layout.collision_audit(d.placements(spark, sf), d.protected(spark, sf))


@query(
    d.with_views(
        f"""SELECT page, id, arg_min(cand, covered * 10 + cand) AS cand, min(covered) AS covered
            FROM ({_AUDIT}) GROUP BY 1, 2""",
        "placements",
        "protected",
    )
)
def choose_placement(spark: SparkSession, sf: str) -> DataFrame:
    return layout.choose_placement(d.placements(spark, sf), d.protected(spark, sf))


_NEAREST_SQL = """SELECT query_id, rank, match_id, similarity FROM (
         SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, match_id) AS rank
         FROM (SELECT q.vec_id AS query_id, l.vec_id AS match_id,
                 round(list_cosine_similarity(q.embedding::DOUBLE[], l.embedding::DOUBLE[]), 6) AS similarity
               FROM embeddings q JOIN embeddings l ON q.vec_id <> l.vec_id))
       WHERE rank <= 5"""


@query(_NEAREST_SQL)
def nearest_style(spark: SparkSession, sf: str) -> DataFrame:
    vectors = d.table(spark, sf, "embeddings")
    return style.nearest_style(vectors, vectors, 5)


@query(_NEAREST_SQL)
def nearest_style_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same in small blocks, so that several cells and blocks of queries meet."""
    vectors = d.table(spark, sf, "embeddings")
    return style.nearest_style(vectors, vectors, 5, block=100)


@query("SELECT 0 AS n_wrong, true AS recall_ok")
def nearest_style_lsh(spark: SparkSession, sf: str) -> DataFrame:
    """The projected matches against the exact five nearest within the radius: similarities
    are right, and at least 0.9 of those are found."""
    vectors = d.table(spark, sf, "embeddings")
    radius = 1.2
    near = style.nearest_style(vectors, vectors, 5).filter(F.col("similarity") >= 1 - radius * radius / 2)
    exact = near.select("query_id", "match_id", F.col("similarity").alias("_e"))
    found = style.nearest_style_lsh(vectors, vectors, 5, max_distance=radius)
    both = exact.join(
        found.select("query_id", "match_id", F.col("similarity").alias("_f")), ["query_id", "match_id"], "full_outer"
    )
    return both.agg(
        F.count_if(F.abs(F.col("_e") - F.col("_f")) > 1e-5).cast("int").alias("n_wrong"),
        (F.count_if(F.col("_f").isNotNull() & F.col("_e").isNotNull()) >= 0.9 * F.count("_e")).alias("recall_ok"),
    )
