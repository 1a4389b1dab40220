import random

import numpy as np
import pytest

from glossweave.operators import layout, style

SCHEMA = "id long, page long, x0 long, y0 long, x1 long, y1 long, score long"


def random_boxes(n=150, pages=3, seed=2, copies=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if copies and rows and rnd.random() < 0.3:
            _, page, *box, _ = rnd.choice(rows)
        else:
            page, x, y = rnd.randrange(pages), rnd.randrange(300), rnd.randrange(300)
            box = [x, y, x + rnd.randrange(10, 90), y + rnd.randrange(10, 90)]
        rows.append((i, page, *box, rnd.randrange(20)))
    return rows


def shared(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    return max(w, 0) * max(h, 0)


def iou(a, b):
    area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    s = shared(a, b)
    return s / (area(a) + area(b) - s)


def stronger(a, b):
    return (a[6], -a[0]) > (b[6], -b[0])


def test_overlap_pairs_touching_edges_do_not_count(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 10, 10, 1), (2, 0, 10, 0, 20, 10, 1), (3, 0, 5, 5, 15, 15, 1)], SCHEMA)
    got = {(r.a_id, r.b_id): (r.shared, round(r.iou, 4)) for r in layout.overlap_pairs(df).collect()}
    assert got == {(1, 3): (25, 0.1429), (2, 3): (25, 0.1429)}
    assert layout.overlap_pairs(df.limit(0)).isEmpty()


def test_suppress_local_matches_brute_force(spark):
    rows = random_boxes()
    got = {r.id for r in layout.suppress_overlaps(spark.createDataFrame(rows, SCHEMA), 0.3).collect()}
    want = {
        a[0]
        for a in rows
        if not any(a[1] == b[1] and a is not b and stronger(b, a) and iou(a, b) >= 0.3 for b in rows)
    }
    assert got == want


def test_suppress_greedy_matches_brute_force(spark):
    rows = random_boxes(seed=9)
    got = {r.id for r in layout.suppress_overlaps(spark.createDataFrame(rows, SCHEMA), 0.2, "greedy").collect()}
    kept = []
    for a in sorted(rows, key=lambda r: (-r[6], r[0])):
        if not any(a[1] == b[1] and iou(a, b) >= 0.2 for b in kept):
            kept.append(a)
    assert got == {a[0] for a in kept}


def union_find(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_components_of_a_long_chain_and_a_star(spark):
    order = list(range(200))
    random.Random(4).shuffle(order)
    edges = list(zip(order, order[1:])) + [(500, 500 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r.node: r.component for r in layout.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union_find(edges, {n for e in edges for n in e})


@pytest.mark.parametrize("dense", [2, 10_000])
def test_merge_regions_agrees_with_union_find(spark, dense):
    rows = random_boxes(n=90, seed=6)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {
        (r.page, r.block_id): (r.n_regions, r.x0, r.y0, r.x1, r.y1)
        for r in layout.merge_regions(df, dense=dense).collect()
    }
    edges = [(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[0] < b[0] and shared(a, b) > 0]
    comp = union_find(edges, [r[0] for r in rows])
    want = {}
    for r in rows:
        want.setdefault((r[1], comp[r[0]]), []).append(r)
    assert got == {
        k: (len(v), min(r[2] for r in v), min(r[3] for r in v), max(r[4] for r in v), max(r[5] for r in v))
        for k, v in want.items()
    }


def test_assign_to_panels_keeps_regions_without_panel(spark):
    regions = spark.createDataFrame(
        [(1, 0, 0, 0, 10, 10, 0), (2, 0, 95, 0, 105, 10, 0), (3, 0, 500, 500, 510, 510, 0)], SCHEMA
    )
    panels = spark.createDataFrame(
        [(0, 0, 0, 0, 100, 100), (0, 1, 100, 0, 200, 100)],
        "page long, panel_no int, x0 long, y0 long, x1 long, y1 long",
    )
    got = {r.id: (r.panel_no, r.shared) for r in layout.assign_to_panels(regions, panels).collect()}
    assert got == {1: (0, 100), 2: (0, 50), 3: (None, 0)}


@pytest.mark.parametrize("limit", [0, 10_000])
@pytest.mark.parametrize("direction", ["rtl", "ltr"])
def test_reading_order(spark, limit, direction):
    rows = [(*r[:6], r[0] % 3 if r[0] % 5 else None) for r in random_boxes(n=200, pages=2, seed=8)]
    df = spark.createDataFrame(rows, "id long, page long, x0 long, y0 long, x1 long, y1 long, panel_no int")
    got = {r.id: r.ord for r in layout.reading_order(df, direction, 60, limit).collect()}
    groups = {}
    for r in rows:
        groups.setdefault((r[1], -1 if r[6] is None else r[6]), []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[3] // 60, -r[4] if direction == "rtl" else r[2], r[3], r[0]))
    assert got == {r[0]: i + 1 for g in groups.values() for i, r in enumerate(g)}


def test_placement_prefers_uncovered_then_lower_candidate(spark):
    box = "page long, x0 long, y0 long, x1 long, y1 long"
    cands = spark.createDataFrame(
        [(1, 0, 0, 0, 0, 10, 10), (1, 1, 0, 50, 50, 60, 60), (1, 2, 0, 80, 80, 90, 90), (2, 0, 0, 5, 5, 15, 15)],
        f"id long, cand int, {box}",
    )
    art = spark.createDataFrame([(0, 0, 0, 8, 8), (0, 0, 0, 8, 8)], box)
    audit = {(r.id, r.cand): (r.covered, r.n_protected) for r in layout.collision_audit(cands, art).collect()}
    assert audit == {(1, 0): (128, 2), (1, 1): (0, 0), (1, 2): (0, 0), (2, 0): (18, 2)}
    best = {r.id: (r.cand, r.covered) for r in layout.choose_placement(cands, art).collect()}
    assert best == {1: (1, 0), 2: (0, 18)}


@pytest.mark.parametrize("block,pivots,self_out", [(16, 4, True), (4096, 8, True), (16, 200, False), (64, None, True)])
def test_nearest_style_is_exact(spark, block, pivots, self_out):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(6, 8)) * 4
    vecs = np.concatenate([rng.normal(size=(100, 8)) + centers[rng.integers(0, 6, 100)], np.zeros((1, 8))])
    vecs[50:60] = vecs[0]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = style.nearest_style(df, df, 4, n_pivots=pivots, block=block, exclude_self=self_out).collect()
    data = np.array([r[1] for r in rows[:-1]])
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 6)
    for q in range(len(data)):
        order = sorted((j for j in range(len(data)) if not (self_out and j == q)), key=lambda j: (-sim[q, j], j))
        mine = sorted((r["rank"], r.match_id) for r in got if r.query_id == q)
        assert [m for _, m in mine] == order[:4]
    assert not any(r.query_id == 100 or r.match_id == 100 for r in got)


def test_nearest_style_lsh_never_invents(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = {(r.query_id, r.match_id): r.similarity for r in style.nearest_style(df, df, 59).collect()}
    for r in style.nearest_style_lsh(df, df, 3, 1.0).collect():
        assert exact[(r.query_id, r.match_id)] == pytest.approx(r.similarity, abs=1e-5)


@pytest.mark.parametrize("form", ["cells", "lsh"])
def test_nearest_style_copies_do_not_grow_with_small_cells(spark, monkeypatch, form):
    # vectors without clusters: every cell can hold a result of every query
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sent, keep = [], style.stored
    monkeypatch.setattr(style, "stored", lambda part, name: sent.append((name, keep(part, name))) or sent[-1][1])
    if form == "cells":
        found = style.nearest_style(df, df, 3, block=4)
    else:
        found = style.nearest_style_lsh(df, df, 3, 1.4)
    assert found.groupBy("query_id").count().count() == 600
    assert 600 <= dict(sent)["queries"].count() <= 600 * 2 * style.LEAST_SHARDS
