"""k-anonymity by partitioning: group sizes, whole results, ranges, nulls."""

import random
from collections import Counter

import pytest

from glossweave.operators.mondrian import narrow_groups
from glossweave.operators.privacy import anonymize_groups, information_loss

SCHEMA = "id long, age long, pay double, town string"
RANGES = ["age_low", "age_high", "pay_low", "pay_high"]


def people(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        age = None if rng.random() < 0.05 else 30 if rng.random() < 0.3 else rng.randrange(100)
        rows.append((i, age, round(rng.expovariate(1 / 1000), 2), "x"))
    return rows


@pytest.mark.parametrize("k", [1, 5, 40])
def test_groups_are_large_enough_and_hold_their_rows(spark, k):
    rows = people(600)
    found = anonymize_groups(spark.createDataFrame(rows, SCHEMA), ["age", "pay"], k)
    assert set(found.columns) == {"id", "town", "group_size", *RANGES}
    got = {r["id"]: r for r in found.collect()}
    assert sorted(got) == list(range(600))
    sizes = Counter(tuple(r[c] for c in RANGES) for r in got.values())
    assert min(sizes.values()) >= k and min(r["group_size"] for r in got.values()) >= k
    for i, age, pay, _ in rows:
        r = got[i]
        assert r["pay_low"] <= pay <= r["pay_high"]
        assert r["age_low"] is None if age is None else r["age_high"] >= age >= (r["age_low"] or 0)


def test_smaller_groups_lose_less(spark):
    df = spark.createDataFrame(people(600), SCHEMA)
    losses = [information_loss(anonymize_groups(df, ["age", "pay"], k), ["age", "pay"]).first() for k in (2, 20, 300)]
    assert [r["rows"] for r in losses] == [600] * 3
    assert losses[0]["loss"] < losses[1]["loss"] < losses[2]["loss"] <= 1 and losses[1]["loss"] < 0.3


def test_a_value_of_many_rows_stays_whole(spark):
    rows = [(i, 7, 1.0, "x") for i in range(50)] + [(50 + i, i, 2.0, "x") for i in range(9)]
    got = anonymize_groups(spark.createDataFrame(rows, SCHEMA), ["age", "pay"], 5).collect()
    shared = {(r["age_low"], r["age_high"], r["pay_low"], r["pay_high"], r["group_size"]) for r in got if r["id"] < 50}
    assert len(shared) == 1 and all(lo <= 7 <= hi and n >= 50 for lo, hi, _, _, n in shared)


def test_too_few_rows_and_none(spark):
    df = spark.createDataFrame(people(3), SCHEMA)
    got = anonymize_groups(df, ["age", "pay"], 5).collect()
    assert len(got) == 3 and all(r[c] is None for r in got for c in RANGES)
    assert anonymize_groups(df.filter("1 = 0"), ["age", "pay"], 5).collect() == []


def test_groups_fill_up_to_k_and_are_narrow(spark):
    """No group is left that could be two, and the ranges are narrower than halving at medians makes them."""
    rng = random.Random(5)
    rows = [(i, rng.randrange(1000), rng.random(), "x") for i in range(760)]
    found = anonymize_groups(spark.createDataFrame(rows, SCHEMA), ["age", "pay"], 25)
    assert {r["group_size"] for r in found.select("group_size").distinct().collect()} <= set(range(25, 50))
    assert found.select(*RANGES).distinct().count() == 30
    assert information_loss(found, ["age", "pay"]).first()["loss"] < 0.19


def test_large_groups_are_cut_at_once_and_counted(spark):
    """Many parts from one tree; a tuple of very many rows and a k beyond a task's tuples are kept whole."""
    rng = random.Random(7)
    tuples = {(float(rng.randrange(300)), rng.random()): 1 for _ in range(6000)}
    tuples[(150.0, 0.5)] = 9000
    rows = [(*t, n) for t, n in tuples.items()]
    df = spark.createDataFrame(rows, "_q0 double, _q1 double, _n long")
    for k, local in ((5, 500), (700, 200), (20_000, 100)):
        got = narrow_groups(df, ["_q0", "_q1"], [300.0, 1.0], k, local).collect()
        assert sorted((r["_q0"], r["_q1"]) for r in got) == sorted(tuples)
        sizes = Counter()
        for r in got:
            assert r["_q0_lo"] <= r["_q0"] <= r["_q0_hi"] and r["_q1_lo"] <= r["_q1"] <= r["_q1_hi"]
            sizes[tuple(r[c] for c in ("_q0_lo", "_q0_hi", "_q1_lo", "_q1_hi", "_size"))] += tuples[r["_q0"], r["_q1"]]
        assert all(n == key[-1] >= min(k, 15_000) for key, n in sizes.items())
        assert len(sizes) == 1 if k == 20_000 else len(sizes) > (700 if k == 5 else 4)
