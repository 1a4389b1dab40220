"""The pipeline's wider near-duplicate groups: links, crowds and linear size."""

import random

import pytest
from pyspark.sql import functions as F

from glossweave.llm import simhash
from glossweave.llm.graph import components
from glossweave.llm.simhash import keep_representatives, near_groups, wide_links

WORDS = [f"word{i}" for i in range(400)]


def signed(f):
    return f - 2**64 if f >= 2**63 else f


def apart(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def test_links_connect_what_lies_within_five_bits(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(60):
        f = rng.choice(sorted(fps))
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            f ^= 1 << bit
        fps.add(f)
    fps = [signed(f) for f in fps]
    links = wide_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert all(apart(r.a, r.b) <= 5 for r in links)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(r.a)] = find(r.b)
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if apart(a, b) <= 5]
    joined = sum(find(a) == find(b) for a, b in pairs)
    assert len(pairs) >= 60 and joined == len(pairs)


@pytest.mark.parametrize("fold", [400, 16])
def test_a_crowd_gives_links_in_proportion(spark, monkeypatch, fold):
    monkeypatch.setattr(simhash, "FOLD", fold)
    centre = random.Random(2).getrandbits(63)
    fps = [centre] + [centre ^ (1 << i) ^ (1 << j) for i in range(32) for j in range(i)]
    links = wide_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    roots = components(links)
    assert links.count() < len(fps) * (len(fps) - 1) / 2 / 4  # far fewer than all pairs
    assert roots.count() == len(fps) and roots.select("root").distinct().count() == 1


def test_near_copies_meet_and_others_do_not(spark):
    rng = random.Random(3)
    rows, group = [], {}
    for g in range(30):
        base = rng.choices(WORDS, k=300)
        for copy in range(rng.randint(1, 6)):
            text = list(base)
            if copy:
                text[rng.randrange(300)] = "changed"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(text)))
    rows += [(1000, None), (1001, " "), (1002, "")]
    group |= {1000: -1, 1001: -1, 1002: -1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_groups(docs).collect()}
    first = {g: min(i for i in group if group[i] == g) for g in set(group.values())}
    assert got == {i: first[g] for i, g in group.items()}


def five(words):
    return set(zip(*(words[i:] for i in range(5))))


def test_nine_in_ten_near_copies_are_found(spark):
    # pairs of a similarity of 0.8 or more on shingles of five words
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in WORDS[:60] for b in "abcdefghijklmnopqrst"]
    rows, pairs = [], []
    while len(pairs) < 150:
        base = rng.choices(vocabulary, k=rng.randrange(150, 600))
        copy = list(base)
        for at in rng.sample(range(len(base)), rng.randrange(1, len(base) // 45 + 1)):
            copy[at] = rng.choice(vocabulary)
        a, b = five(base), five(copy)
        if len(a & b) / len(a | b) >= 0.8:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    got = {r["doc_id"]: r["component_id"] for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(got[i] in (i, i - 1) for i in got)  # nothing else is linked


def test_many_copies_of_one_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one text for all of us here").alias("text"))
    assert [r[0] for r in near_groups(docs).select("component_id").distinct().collect()] == [0]


def three(*values):
    """One node of three fingerprints; its id is given."""
    node, *fps = values
    return node, [signed(f) for f in fps]


@pytest.mark.parametrize("fold", [400, 2])
def test_members_of_a_rejecting_leader_meet(spark, monkeypatch, fold):
    # 1 sorts first and shares a half with 2 and 3, but only 2 and 3 are near over all 192 bits
    monkeypatch.setattr(simhash, "FOLD", fold)
    high = lambda n, at=0: sum(1 << (32 + i) for i in range(at, at + n))
    rows = [
        three(1, 7, 0, 0),
        three(2, 7 ^ high(5), high(10), high(10)),
        three(3, 7 ^ high(4) ^ high(2, 8), high(16), high(16)),
    ]
    assert [sum(apart(a, b) for a, b in zip(rows[i][1], rows[j][1])) for i, j in ((0, 1), (0, 2), (1, 2))] == [25, 38, 15]
    nodes = spark.createDataFrame(rows, "node long, fps array<long>")
    for at in range(3):
        assert {(r.a, r.b) for r in simhash.node_links(nodes, at, 3, 23).distinct().collect()} <= {(2, 3), (3, 2)}
    found = simhash.node_links(nodes, 0, 3, 23).distinct().collect()
    assert {frozenset(r) for r in found} == {frozenset((2, 3))}


@pytest.mark.parametrize("fold", [400, 16])
def test_a_crowd_of_one_fingerprint_that_is_unlike_elsewhere(spark, monkeypatch, fold):
    # all share the first fingerprint; the others pair them off
    monkeypatch.setattr(simhash, "FOLD", fold)
    rng = random.Random(4)
    rows = []
    for i in range(60):
        second, third = rng.getrandbits(64), rng.getrandbits(64)
        rows += [three(2 * i, 5, second, third), three(2 * i + 1, 5, second ^ (0x15 << 40), third ^ (0x7 << 20) ^ (0x7 << 50))]
    nodes = spark.createDataFrame(rows, "node long, fps array<long>")
    got = {frozenset(r) for r in simhash.node_links(nodes, 0, 3, 23).collect()}
    assert got == {frozenset((2 * i, 2 * i + 1)) for i in range(60)}


def linked(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(r.a)] = find(r.b)
    return find


@pytest.mark.parametrize("crowd", [0, 80])
def test_an_unrelated_crowd_costs_no_links(spark, monkeypatch, crowd):
    # twenty small groups hold two near nodes each; a crowd of unlike nodes ends the rounds of splitting
    monkeypatch.setattr(simhash, "FOLD", 8)
    rng = random.Random(6)
    rows, pairs = [], []
    for _ in range(20):
        low = rng.getrandbits(32)
        for _ in range(2):
            a = [low | rng.getrandbits(32) << 32, rng.getrandbits(64), rng.getrandbits(64)]
            flip = lambda f, n, at: f ^ sum(1 << b for b in rng.sample(range(at, 64), n))
            b = [flip(a[0], 7, 32), flip(a[1], 8, 0), flip(a[2], 8, 0)]
            pairs.append((len(rows), len(rows) + 1))
            rows += [three(len(rows), *a), three(len(rows) + 1, *b)]
        for _ in range(6):
            rows.append(three(len(rows), low | rng.getrandbits(32) << 32, rng.getrandbits(64), rng.getrandbits(64)))
    for _ in range(crowd):
        rows.append(three(len(rows), 99 | rng.getrandbits(32) << 32, rng.getrandbits(64), rng.getrandbits(64)))
    nodes = spark.createDataFrame(rows, "node long, fps array<long>")
    find = linked(simhash.node_links(nodes, 0, 3, 23).collect(), [r[0] for r in rows])
    assert sum(find(a) == find(b) for a, b in pairs) == len(pairs) == 40


@pytest.mark.parametrize("fold", [400, 2])
def test_members_of_different_leaders_meet(spark, monkeypatch, fold):
    # 3 gives way to 1 and 4 to 2; 1 and 2 are apart, and only 3 and 4 connect the two groups
    monkeypatch.setattr(simhash, "FOLD", fold)
    bits = lambda n: (1 << n) - 1
    rows = [three(1, 5, 0, 0), three(2, 5, bits(36), 0), three(3, 5, bits(12), 0), three(4, 5, bits(24), 0)]
    find = linked(simhash.node_links(spark.createDataFrame(rows, "node long, fps array<long>"), 0, 3, 23).collect(), range(1, 5))
    assert len({find(n) for n in range(1, 5)}) == 1


def test_members_that_gave_way_in_both_halves_enter_the_grid(spark):
    # 3 gives way to 1 in its low half and to 2 in its high half; 4 is near to 3 only, and shares no half
    bits = lambda n: (1 << n) - 1
    high = bits(8) << 40
    rows = [
        three(1, 7, 0, 0), three(2, high | 7 ^ bits(8) << 8, 0, 0), three(3, high | 7, 0, 0), three(4, high | 7 ^ (1 << 20) ^ (1 << 60), bits(14), 0),
    ]
    assert [sum(apart(a, b) for a, b in zip(rows[3][1], r[1])) for r in rows[:3]] == [24, 24, 16]
    find = linked(simhash.node_links(spark.createDataFrame(rows, "node long, fps array<long>"), 0, 3, 23).collect(), range(1, 5))
    assert len({find(n) for n in range(1, 5)}) == 1


def test_representatives_are_chosen_row_by_row(spark):
    rng = random.Random(5)
    own = [" ".join(rng.choices(WORDS, k=200)) for _ in range(6)]
    near = [t + " more" for t in own]
    rows = [
        (1, own[0]), (None, near[0]),  # a null id in a group with another id
        (None, own[1]),  # a null id with a text of its own
        (None, own[2]), (None, near[2]),  # null ids that form a group
        (2, own[3]), (3, near[3]), (3, own[4]),  # an id with a near copy and a text of its own
        (4, own[5]), (4, near[5]), (4, own[5]),  # an id in one group with itself, and a repeated row
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in keep_representatives(docs).collect()]
    group = {t: i for i, pair in enumerate(zip(own, near)) for t in pair}
    assert sorted((group[t], i or 0) for i, t in got) == [(0, 1), (1, 0), (2, 0), (3, 2), (4, 3), (5, 4)]


@pytest.mark.parametrize("fold", [400, 4])
def test_all_fingerprints_in_one_go_connect_what_their_pairs_do(spark, monkeypatch, fold):
    # crowds that share a half of some fingerprint, thinned in one and not in another
    monkeypatch.setattr(simhash, "FOLD", fold)
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = [rng.getrandbits(64) if g % 3 else 77 | rng.getrandbits(32) << 32, rng.getrandbits(64), 5 if g % 2 else rng.getrandbits(64)]
        for _ in range(6):
            flips = [sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for _ in base]
            rows.append(three(len(rows), *[f ^ x for f, x in zip(base, flips)]))
    total = lambda a, b: sum(apart(x, y) for x, y in zip(a, b))
    half = lambda x, y: (x ^ y) & 0xFFFFFFFF == 0 or ((x ^ y) >> 32) & 0xFFFFFFFF == 0
    pairs = [
        (i, j) for i, a in rows for j, b in rows
        if i < j and total(a, b) <= 23 and any(half(x, y) or apart(x, y) <= 5 for x, y in zip(a, b))
    ]
    find = linked(simhash.node_links(spark.createDataFrame(rows, "node long, fps array<long>"), range(3), 3, 23).collect(), range(len(rows)))

    class Pair:
        def __init__(self, a, b):
            self.a, self.b = a, b

    want = linked([Pair(*p) for p in pairs], range(len(rows)))
    same = lambda f: {(i, j) for i, _ in rows for j, _ in rows if f(i) == f(j)}
    assert len(pairs) > 60 and same(find) == same(want)


def test_a_stored_step_leaves_no_shuffle_files(spark):
    from glossweave.session import CLEANUP, stored

    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (held.apply(i).getName() for i in range(held.size())) if f.startswith("shuffle_")}

    before = files()
    step = stored(spark.range(5000).groupBy((F.col("id") % 77).alias("k")).agg(F.count("id").alias("n")))
    assert not files() - before and spark.conf.get(CLEANUP, None) is None
    assert step.count() == 77 and step.agg(F.sum("n")).first()[0] == 5000
