"""The grid with levels against all pairs compared by hand."""

import random

import pytest
from pyspark.sql import functions as F

from glossweave.operators import layout
from glossweave.plans import levels
from glossweave.plans.levels import level_join

SCHEMA = "id long, page long, x0 long, y0 long, x1 long, y1 long, score long"


def boxes(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w, h = (rng.choice([1, 5, 60, 128, 129, 700, 5000, 100_000]) for _ in range(2))
        x, y = rng.randrange(-3000, 9000), rng.randrange(-3000, 9000)
        rows.append((i, i % 2, x, y, x + w, y + h, i))
    return rows


def overlapping(a, b):
    return a[1] == b[1] and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]


@pytest.mark.parametrize("crowd", [2000, 3])
def test_every_pair_once(spark, crowd):
    left, right = boxes(1, 200), boxes(2, 150)
    frames = [spark.createDataFrame(rows, SCHEMA).select("id", "page", *layout.BOX) for rows in (left, right)]
    got = sorted((r.a_id, r.b_id) for r in level_join(*frames, crowd=crowd).collect())
    assert got == sorted((a[0], b[0]) for a in left for b in right if overlapping(a, b))


def test_a_huge_box_makes_few_rows(spark):
    rows = [(0, 0, 3, 3, 100_003, 100_003, 1)] + [(i, 0, 10 * i, 10 * i, 10 * i + 9, 10 * i + 9, 1) for i in range(1, 50)]
    df = spark.createDataFrame(rows, SCHEMA)
    present = sorted({r[0] for r in df.select(levels.level_of()).collect()})
    placed = levels._placed(df.filter("id = 0"), ["page"], "a_", present, levels.BASE, ((0,), (1,)))
    assert placed.count() <= 4
    assert level_join(df, df).filter("a_id = 0 AND b_id <> 0").count() == 49


def test_a_crowded_cell_is_spread(spark):
    # one cell holds boxes side by side that do not overlap
    thin = spark.range(3000).select("id", F.lit(0).alias("page"), (F.col("id") % 60 * 2).alias("x0"), (F.floor(F.col("id") / 60) * 2).alias("y0"))
    df = thin.select("*", (F.col("x0") + 1).alias("x1"), (F.col("y0") + 1).alias("y1"))
    pairs = level_join(df, df, crowd=500)
    assert "_ga" in pairs._jdf.queryExecution().toString()
    assert pairs.count() == 3000


def test_operators_agree_with_one_cell_size(spark):
    df = spark.createDataFrame(boxes(3, 120), SCHEMA)
    other = df.select(F.col("id").alias("panel_no"), "page", *layout.BOX).filter("panel_no % 3 = 0")
    for run in (
        lambda cell: layout.overlap_pairs(df, 0.01, cell),
        lambda cell: layout.assign_to_panels(df, other, cell),
        lambda cell: layout.collision_audit(df.withColumn("cand", F.lit(0)), other, cell),
    ):
        assert sorted(map(tuple, run(None).collect())) == sorted(map(tuple, run(4096).collect()))


def test_null_sides_and_no_boxes(spark):
    df = spark.createDataFrame([(1, 0, None, 0, 5, 5, 1), (2, 0, 0, 0, 5, 5, 1)], SCHEMA)
    assert [(r.a_id, r.b_id) for r in level_join(df, df).collect()] == [(2, 2)]
    assert level_join(df.filter("1 = 0"), df).collect() == []


def test_cells_of_one_table_are_counted_once(spark):
    """Counts of a table met with itself are those of two tables with the same rows."""
    from glossweave.plans.levels import _placed, _sizes

    rows = [(1, i, i % 90 * 3, i % 70 * 5, i % 90 * 3 + 20 + i % 200, i % 70 * 5 + 40) for i in range(300)]
    boxes = spark.createDataFrame(rows, "page long, id long, x0 long, y0 long, x1 long, y1 long")
    keys = ["page", "_at", "_cx", "_cy", "_kind"]
    a = _placed(boxes, ["page"], "a_", [0, 1], 128, ((0,), (1,)))
    once, twice = (sorted(map(tuple, _sizes(a, other, keys).collect())) for other in (None, a))
    b = _placed(boxes, ["page"], "b_", [0, 1], 128, ((0, 1), (0,)))
    plain = a.groupBy(*keys).count().join(b.groupBy(*keys).count().withColumnRenamed("count", "n_b"), keys)
    assert once == twice and [r for r in once if r[-1] and r[-2]] == sorted(map(tuple, plain.collect()))


def test_boxes_are_sent_only_to_levels_of_the_other_side(spark, monkeypatch):
    sent, place = [], levels._placed

    def placed(*args):
        sent.append(place(*args))
        return sent[-1]

    monkeypatch.setattr(levels, "_placed", placed)
    box = "page long, id long, x0 long, y0 long, x1 long, y1 long"
    small = spark.createDataFrame([(0, i, 10 * i, 0, 10 * i + 5, 5) for i in range(10)] + [(0, 10, 0, 0, 200, 9)], box)
    large = spark.createDataFrame([(0, 0, 0, 0, 470, 437)], box)
    assert level_join(small, large).count() == 11
    assert {(r["_at"], r["_kind"]) for r in sent[0].collect()} == {(2, 1)}
