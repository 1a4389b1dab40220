"""HyperMinHash near-dedup against all pairs compared by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.llm import hyperminhash as hm
from glossweave.llm.hyperminhash import similarity_groups

WORDS = [f"w{i}" for i in range(500)]


def brute(rows):
    """{row number: (n, component)} of (doc_id, text) rows with distinct ids."""
    sets = [hm.shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (key, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(key)
    return {key: (len(sets[i]), min(ids[find(i)])) for i, (key, _) in enumerate(rows)}


def edited(rng, words, share):
    return [rng.choice(WORDS) if rng.random() < share else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(25):
        base = rng.choices(WORDS, k=rng.choice([3, 8, 30, 300, 2000]))
        for _ in range(rng.randint(1, 8)):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.02, 0.05, 0.08, 0.12]))))
    chain = rng.choices(WORDS, k=200)  # neighbours are linked, the ends are not
    for i in range(20):
        rows.append(" ".join(chain))
        chain = chain[12:] + rng.choices(WORDS, k=12)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [1000, 3])
def test_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(hm, "BLOCK", block)
    rows = corpus(block)
    got = similarity_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = brute(rows)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_members_that_reject_their_leader_still_meet(spark):
    # of three texts only the two that come later are linked, but all share many bands
    rng = random.Random(4)
    base = rng.choices(WORDS, k=400)
    far, one = list(base), list(base)
    far[:44] = rng.choices(WORDS, k=44)
    one[-20:] = rng.choices(WORDS, k=20)
    two = list(one)
    two[-40:-20] = rng.choices(WORDS, k=20)
    rows = [(0, " ".join(far)), (1, " ".join(one)), (2, " ".join(two))]
    assert brute(rows) == {r[0]: (r[1], r[2]) for r in similarity_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_estimates_are_close():
    rng = random.Random(2)
    for size in (40, 400, 20_000):
        for share in (0.3, 0.8, 0.95):
            both = int(2 * size * share / (1 + share))
            pool = [b"%d" % rng.getrandbits(60) for _ in range(2 * size - both)]
            a, b = hm.sketch(pool[:size]), hm.sketch(pool[size - both :])
            exact = both / len(pool)
            got = hm.estimate(a, b, np.array(size), np.array(size))
            assert abs(got - exact) < 0.15


def test_chance_agreement_is_measured():
    agree = []
    for i in range(20):
        a, b = (hm.sketch(b"%d:%d:%d" % (i, side, x) for x in range(5000)) for side in (0, 1))
        agree.append((a == b).mean())
    chance = hm._chances()[hm._load(np.array(5000)), hm._load(np.array(5000))]
    assert 0 < chance < 0.002 and abs(np.mean(agree) - chance) < 0.001


def test_edges(spark):
    text = "The same text with a few more words in it, twice."
    rows = [
        (1, text), (2, text.upper()), (3, None), (4, ""), (5, " \n"), (6, "single"), (7, "Single"), (8, "two words"),
        (9, "word " * 40_000 + "end"), (9, "word " * 40_000 + "end"), (None, text), (None, "an id it has not"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("clash") for c in ("node", "digest", "key", "row_hash", "a", "b", "registers", "n_shingles")}
    )
    got = sorted(map(str, map(tuple, similarity_groups(docs).collect())))
    want = [
        (1, 10, 1, True), (2, 10, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True),
        (7, 1, 6, False), (8, 1, 8, True), (9, 2, 9, True), (9, 2, 9, True), (None, 10, 1, False), (None, 4, None, True),
    ]
    assert got == sorted(map(str, want))
    assert similarity_groups(docs.filter("1 = 0")).collect() == []
