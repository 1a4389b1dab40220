"""The chunked windows give the plain window's result, whether or not a key is hot."""

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from glossweave.plans.scale import exact_quantiles, grid_join, hot_keys, mark_chunks, running_sum


def skewed(n=600, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rnd.random() < 0.5 else rnd.randrange(1, 30)
        rows.append((key, i, rnd.randrange(50), rnd.randrange(10)))
    return rows


@pytest.mark.parametrize("limit", [0, 40, 10_000])
def test_running_sum_matches_plain_window(spark, limit):
    df = spark.createDataFrame(skewed(), "k int, id int, a int, b int")
    w = Window.partitionBy("k").orderBy("a", "b", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.id, r.s) for r in df.withColumn("s", F.sum("b").over(w)).collect()}
    got = running_sum(
        df,
        ["k"],
        [F.col("a"), F.col("b"), F.col("id")],
        F.col("b"),
        "s",
        limit,
    )
    assert got.columns == ["k", "id", "a", "b", "s"]
    assert {(r.id, r.s) for r in got.collect()} == want


def test_every_key_above_the_limit_is_hot(spark):
    df = spark.createDataFrame([(i % 500, i) for i in range(2_000)], "k int, id int")
    assert hot_keys(df, ["k"], 4) is None
    assert hot_keys(df, ["k"], 3).count() == 500
    assert hot_keys(df.withColumn("k", F.lit(1)), ["k"], 3).count() == 1


ORDERS = {
    "fractional": lambda rnd, i: rnd.random() * 10,
    "nulls": lambda rnd, i: None if rnd.random() < 0.3 else rnd.random(),
    "ties": lambda rnd, i: float(rnd.randrange(3)),
    "sparse": lambda rnd, i: float(rnd.randrange(10) * 10**12 + i),
    "one value": lambda rnd, i: 0.5,
}


@pytest.mark.parametrize("kind", [*ORDERS, "time", "text"])
@pytest.mark.parametrize("limit", [1, 7, 60])
def test_chunks_of_any_order(spark, kind, limit):
    """The same numbers as the plain window, for whatever the order column holds."""
    rnd = random.Random(9)
    rows = [(rnd.choice([0, 0, 0, 1, 2]), i, ORDERS.get(kind, ORDERS["nulls"])(rnd, i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, id int, o double")
    if kind == "time":
        df = df.withColumn("o", F.timestamp_seconds(F.col("o") * 1e6))
    if kind == "text":
        df = df.withColumn("o", F.col("o").cast("string"))
    w = Window.partitionBy("k").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.id, r.s) for r in df.withColumn("s", F.sum("id").over(w)).collect()}
    got = running_sum(df, ["k"], [F.col("o"), F.col("id")], F.col("id"), "s", limit)
    assert {(r.id, r.s) for r in got.collect()} == want
    marked = mark_chunks(df, ["k"], [F.col("o"), F.col("id")], limit)
    if limit == 7:
        sizes = [r["count"] for r in marked.groupBy("k", "_chunk").count().collect()]
        assert len(sizes) > 10 and max(sizes) < 80


@pytest.mark.parametrize("edges", [2, 8, 64])
def test_exact_quantiles(spark, edges):
    rnd = random.Random(3)
    rows = [("hot", rnd.choice([1.0, 1.0, 1.0, rnd.random() * 100])) for _ in range(500)]
    rows += [("one", 7.5)] + [("two", v) for v in (1.0, 2.0)] + [("two", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.p50, r.p95) for r in exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}, edges).collect()}
    for key in ("hot", "one", "two"):
        vals = [v for k, v in rows if k == key and v is not None]
        assert got[key] == pytest.approx(tuple(np.quantile(vals, [0.5, 0.95])))


@pytest.mark.parametrize("cell", [8, 64, 1000])
def test_grid_join_reports_each_pair_once(spark, cell):
    rnd = random.Random(5)
    boxes = []
    for i in range(120):
        x, y = rnd.randrange(-50, 200), rnd.randrange(-50, 200)
        boxes.append((rnd.randrange(2), i, x, y, x + rnd.randrange(1, 60), y + rnd.randrange(1, 60)))
    df = spark.createDataFrame(boxes, "page long, id long, x0 long, y0 long, x1 long, y1 long")
    got = sorted((r.a_id, r.b_id) for r in grid_join(df, df, cell).collect())
    want = sorted(
        (a[1], b[1])
        for a in boxes
        for b in boxes
        if a[0] == b[0] and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]
    )
    assert got == want
