"""The conversation trie against a brute-force trie, with and without bursts."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glossweave.llm import turn_trie
from glossweave.llm.turn_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tid = sha(f"{len(role)}:{role}{text}")[:16]
            own[conv].append((turn is not None, turn or 0, tid, role, text))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    members, ended = defaultdict(set), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c - 100 * int(c / 100))
        seq = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
        ended[seq].add(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
            sum(len(x) == len(node) + 1 for x in below),
            sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
            hashlib.sha256(",".join(map(str, sorted(ended[node]))).encode()).hexdigest(),
        ))
    return sorted(map(str, out))


def made(seed, n):
    rng = random.Random(seed)
    texts = ["hello", "same", "other é", "", "long " * 20]
    rows = []
    for _ in range(n):
        conv = rng.choice([rng.randrange(60), 100 + rng.randrange(30), 250, -7])
        for turn in range(rng.randrange(0, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(texts)))
    common = [("system", "you are"), ("user", "hi"), ("assistant", "yes")]
    for conv in range(1000, 1060):  # one conversation that many share
        rows += [(conv, i, role, text) for i, (role, text) in enumerate(common)]
    return rows


@pytest.mark.parametrize("limit", [200_000, 40, 1])
def test_equals_a_brute_force_trie(spark, limit):
    rows = made(1, 60)
    rows += [(5, None, None, None), (5, None, "user", None), (6, 3, "user", "x"), (6, 3, "user", "x"), (None, 1, "user", "lost")]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("head", F.lit("clash")).withColumn("seq", F.lit(1))
    got = conversation_trie(table, limit)
    assert got.columns == COLUMNS
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_long_and_turnless_conversations(spark):
    rows = [(1000, i, "user", f"t{i}" * 50) for i in range(60)] + [(1001, i, "user", f"t{i}" * 50) for i in range(59)]
    rows += [(c, 0, "user", "one") for c in range(1, 12)]  # without conversation 0 their only turn goes
    got = conversation_trie(spark.createDataFrame(rows, SCHEMA), 100)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_empty_table(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ends_are_hashed_in_order_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "PIECE", 7)
    rows = spark.range(5000).select(F.lit(3).cast("long").alias("first"), F.col("id").alias("conv_id"))
    got = turn_trie.ends_digests(rows).collect()
    want = hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()
    assert [(r["first"], r["ends_sha256"]) for r in got] == [(3, want)]
