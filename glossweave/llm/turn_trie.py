"""Prefix trie over conversations, built as a burst trie.

A turn is known by an id, the first 16 bytes of the SHA-256 of its role and text.  A
container holds the suffixes of all conversations below one trie head; at first the root
is the only head.  A container with more than ``LIMIT`` turns is burst: its node becomes
an inner head, and its suffixes move to one container for each next turn.  What is left
is small: each container is sorted in one task and swept into nodes.  Equal conversations
are one suffix with a count, so a conversation that makes up a third of all rows leaves
each task as one row, and a first turn that all share only makes its container burst.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, functions as F

from glossweave.llm.common import map_rows, text_of, union_all
from glossweave.plans.scale import running_sum
from glossweave.session import stored

#: Turns a container may hold before it bursts.
LIMIT = 200_000
#: Conversation ids joined to one piece of text.
PIECE = 1000

_TURN = "struct<tid:binary,len:bigint>"
_SUFFIX = f"array<{_TURN}>"
_NODE = (
    "head array<binary>, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_first long, top boolean"
)


def number_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn): the turns of each conversation, numbered from one.

    Turns are ordered by number, null first, and by turn id where numbers tie; repeated
    rows are turns of their own.  Rows without a conv_id belong to no conversation.
    """
    role, text = text_of(conversations, "role"), text_of(conversations, "text")
    known = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = stored(
        conversations.filter(F.col("conv_id").isNotNull()).select(
            "conv_id",
            "turn",
            F.substring(F.unhex(known), 1, 16).alias("tid"),
            F.length(text).cast("long").alias("len"),
        ),
        "turns",
    )
    numbered = running_sum(rows, ["conv_id"], [F.col("turn"), F.col("tid")], F.lit(1), "pos")
    return numbered.select("conv_id", F.col("pos").cast("long").alias("pos"), F.struct("tid", "len").alias("turn"))


def rebuild(numbered: DataFrame, block: int = 100, most: int = 5) -> DataFrame:
    """(conv_id, seq): each conversation c with the first h turns of conversation c - c % ``block``.

    h is the CRC-32 of the decimal id modulo ``most`` + 1; c's own first h turns go.  A
    conversation may end up without turns.  A conversation's turn ids (16 bytes each) are
    one array.
    """
    c = F.col("conv_id")
    convs = numbered.select("conv_id").distinct().select(
        "conv_id", (c - c % block).alias("_base"), (F.crc32(c.cast("string")) % (most + 1)).alias("_h")
    )
    lent = numbered.filter(F.col("pos") <= most).withColumnRenamed("conv_id", "_base")
    borrowed = lent.join(convs, "_base").filter(F.col("pos") <= F.col("_h")).select("conv_id", "pos", "turn")
    own = numbered.filter(F.col("pos") > F.crc32(c.cast("string")) % (most + 1)).select("conv_id", "pos", "turn")
    bare = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast(_TURN).alias("turn"))
    placed = F.when(F.col("pos") > 0, F.struct("pos", "turn"))
    return (
        own.unionByName(borrowed)
        .unionByName(bare)
        .groupBy("conv_id")
        .agg(F.transform(F.array_sort(F.collect_list(placed)), lambda x: x["turn"]).cast(_SUFFIX).alias("seq"))
    )


def burst(groups: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Containers (head, last, tail, n, first), inner heads (head, last), and what ends at them.

    ``groups`` has a row (seq, n, first) for each distinct sequence of turns.  A head is
    the path of turn ids from the root, ``last`` the length of its last turn.  Rounds go
    on until no container of several suffixes holds more than ``limit`` turns.
    """
    live = groups.select(
        F.array().cast("array<binary>").alias("head"), F.lit(0).cast("long").alias("last"),
        F.col("seq").alias("tail"), "n", "first",
    )
    small, inner, ended = [], [], []
    while True:
        sizes = live.groupBy("head").agg(
            F.sum(F.size("tail")).alias("_turns"), F.count("n").alias("_rows"), F.first("last").alias("_last")
        )
        crowded = stored(sizes.filter((F.col("_turns") > limit) & (F.col("_rows") > 1)), "crowded")
        if crowded.isEmpty():
            break
        small.append(live.join(crowded, "head", "left_anti"))
        inner.append(crowded.select("head", F.col("_last").alias("last")))
        moved = live.join(crowded.select("head"), "head", "left_semi")
        ended.append(moved.filter(F.size("tail") == 0).select("head", "n", "first"))
        turn = F.col("tail")[0]
        live = stored(
            moved.filter(F.size("tail") > 0).select(
                F.concat("head", F.array(turn["tid"])).alias("head"), turn["len"].alias("last"),
                F.slice("tail", 2, F.size("tail")).alias("tail"), "n", "first",
            ),
            "burst",
        )
    containers = union_all([*small, live])
    if not inner:
        return containers, None, None
    return containers, stored(union_all(inner), "heads"), stored(union_all(ended), "ended")


def sweep_container(head: list, last: int, suffixes: list[tuple]) -> Iterator[tuple]:
    """The nodes of one container, from suffixes (turn ids, lengths, n, first), in no given order."""
    depth, length, parent = [len(head)], [last], [-1]
    n, lowest, children, leaves, ends = [0], [None], [0], [0], [None]
    path, before = [0], []
    for tids, lens, count, first in sorted(suffixes, key=lambda s: s[0]):
        shared = next((i for i, (a, b) in enumerate(zip(tids, before)) if a != b), min(len(tids), len(before)))
        del path[shared + 1 :]
        for i in range(shared, len(tids)):
            parent.append(path[-1])
            depth.append(depth[path[-1]] + 1)
            length.append(lens[i])
            for column, start in ((n, 0), (lowest, None), (children, 0), (leaves, 0), (ends, None)):
                column.append(start)
            path.append(len(n) - 1)
        node = path[-1]
        n[node], lowest[node], ends[node] = count, first, first
        before = tids
    saved = [0] * len(n)
    for i in range(len(n) - 1, -1, -1):  # nodes come after their parents
        leaves[i] += not children[i]
        saved[i] += (n[i] - 1) * length[i]
        up = parent[i]
        if up >= 0:
            n[up] += n[i]
            lowest[up] = lowest[i] if lowest[up] is None else min(lowest[up], lowest[i])
            children[up] += 1
            leaves[up] += leaves[i]
            saved[up] += saved[i]
    for i, up in enumerate(parent):
        above = None if up < 0 else lowest[up]
        own = head if up < 0 else None
        yield own, lowest[i], depth[i], above, n[i], children[i], leaves[i], saved[i], ends[i], up < 0


def _sweep(rows: Iterable[tuple]) -> Iterator[tuple]:
    for head, group in groupby(rows, key=lambda r: r[0]):
        held = list(group)
        yield from sweep_container(head, held[0][1], [r[2:] for r in held])


def _paths(head: Column, upto: Column) -> Column:
    """The prefixes of a path with 0 to ``upto`` turns."""
    return F.transform(F.sequence(F.lit(0), upto), lambda i: F.slice(head, F.lit(1), i))


def _inner_nodes(tops: DataFrame, inner: DataFrame, ended: DataFrame) -> DataFrame:
    """Nodes of the burst heads, summed over the containers below them."""
    size, head = F.size("head"), F.col("head")
    above = F.slice("head", F.lit(1), size - 1)
    below = tops.select(
        F.explode(_paths(head, size - 1)).alias("head"), "n_convs", "conv_id", "n_leaves", "saved_tokens"
    )
    here = ended.select(
        F.explode(_paths(head, size)).alias("head"), F.col("n").alias("n_convs"), F.col("first").alias("conv_id"),
        F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
    )
    sums = below.unionByName(here).groupBy("head").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("_below"),
    )
    heads = stored(inner.join(sums, "head"), "inner")
    own = heads.select(
        F.explode(_paths(head, size)).alias("head"), ((F.col("n_convs") - 1) * F.col("last")).alias("_saved")
    ).groupBy("head").agg(F.sum("_saved").alias("_own"))
    nested = tops.select(above.alias("head")).unionByName(heads.filter(size > 0).select(above.alias("head")))
    children = nested.groupBy("head").agg(F.count(F.lit(1)).alias("n_children"))
    ends = ended.groupBy("head").agg(F.min("first").alias("ends_first"))
    return heads.join(own, "head").join(children, "head").join(ends, "head", "left").select(
        "head", "conv_id", size.cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", (F.col("_below") + F.col("_own")).alias("saved_tokens"),
        "ends_first", F.lit(True).alias("top"),
    )


def ends_digests(members: DataFrame) -> DataFrame:
    """(first, ends_sha256) from (first, conv_id): ids ascending, joined by commas.

    The ids are sorted by range over all tasks and joined to pieces of ``PIECE`` ids, so
    that the task which hashes a node's ids in order reads a row for each piece.
    """

    def pieces(rows: Iterable[tuple]) -> Iterator[tuple]:
        for first, group in groupby(rows, key=lambda r: r[0]):
            held: list[int] = []
            for _, conv in group:
                held.append(conv)
                if len(held) >= PIECE:
                    yield first, held[0], ",".join(map(str, held))
                    held = []
            if held:
                yield first, held[0], ",".join(map(str, held))

    def digests(rows: Iterable[tuple]) -> Iterator[tuple]:
        for first, group in groupby(rows, key=lambda r: r[0]):
            digest, comma = hashlib.sha256(), b""
            for _, _, ids in group:
                digest.update(comma + ids.encode())
                comma = b","
            yield first, digest.hexdigest()

    spread = members.repartitionByRange("first", "conv_id").sortWithinPartitions("first", "conv_id")
    parts = map_rows(spread, [F.col("first"), F.col("conv_id")], "first long, start long, ids string", pieces)
    met = parts.repartition("first").sortWithinPartitions("first", "start")
    return map_rows(met, [F.col(c) for c in met.columns], "first long, ends_sha256 string", digests)


def trie_nodes(sequences: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the prefix trie of (conv_id, seq), one row each.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens (of the subtree: members but one, times
    the code points of the node's turn), ends_sha256 (ids of the members that end here).
    Without a conversation there is no root and no row.
    """
    sequences = stored(sequences, "sequences")
    groups = stored(
        sequences.groupBy("seq").agg(F.count("conv_id").alias("n"), F.min("conv_id").alias("first")), "suffixes"
    )
    containers, inner, ended = burst(groups, limit)
    met = containers.repartition("head").sortWithinPartitions("head")
    columns = [
        F.col("head"), F.col("last"), F.col("tail.tid").alias("tids"), F.col("tail.len").alias("lens"),
        F.col("n"), F.col("first"),
    ]
    nodes = stored(map_rows(met, columns, _NODE, _sweep), "nodes")
    if inner is not None:
        tops = nodes.filter("top")
        heads = stored(_inner_nodes(tops, inner, ended), "inner_nodes")
        linked = tops.unionByName(heads).withColumn("_above", F.slice("head", F.lit(1), F.greatest(F.size("head") - 1, F.lit(0))))
        known = heads.select(F.col("head").alias("_above"), F.col("conv_id").alias("_up"))
        linked = linked.join(known, "_above", "left").withColumn(
            "parent_conv_id", F.when(F.size("head") > 0, F.col("_up"))
        )
        nodes = nodes.filter("not top").unionByName(linked.select(nodes.columns))
    digests = ends_digests(stored(sequences.join(groups, "seq").select("first", "conv_id"), "members"))
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(digests, F.col("ends_first") == F.col("first"), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The prefix trie of all rebuilt conversations, see ``rebuild`` and ``trie_nodes``.

    A null role or text counts as empty, a null turn comes first, and rows without a
    conv_id are left out, as they belong to no conversation.  Repeated rows are turns of
    their own.  Texts count by their digest and length, however long.  An empty table
    gives no rows; other columns are ignored.
    """
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return trie_nodes(rebuild(stored(number_turns(own), "numbered")), limit)
