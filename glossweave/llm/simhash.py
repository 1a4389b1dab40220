"""Near duplicates by SimHash fingerprints, joined in a popcount embedding.

A 64-bit fingerprint is cut into 16 segments; the numbers of set bits of the segments
form a vector.  Flipping one bit changes one number by one, so the Manhattan distance
of two vectors never exceeds the Hamming distance of their fingerprints.  Fingerprints
within two bits therefore lie in the same cell of the integer grid or within two steps
of each other.  Every such pair of cells meets in exactly one cell to which both rows
are sent, and the join compares the fingerprints themselves.

Only distinct fingerprints are joined, so copies never meet each other, and a
fingerprint has at most 2080 others within two bits, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from glossweave.llm.common import fresh, map_rows, text_of, type_of, union_all
from glossweave.llm.graph import components
from glossweave.session import stored

SEGMENTS, WIDTH = 16, 4
#: Bits of a packed vector per segment; a count plus one, moved by one, is 0 to 6.
FIELD = 3
#: Shingle hashes counted at a time, so a very long text needs no more memory.
BLOCK = 1 << 15
#: Differing bits that still link near copies in ``near_groups``; the halves' join is exact up to five.
WIDE_BITS = 5
#: Words of a shingle in ``near_groups``.
NEAR_SHINGLE = 2
WIDE_SHARE = 0.12
#: Fingerprints of one group that one task compares with each other's leaders.
FOLD = 400


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text as a signed 64-bit number; a text without words has 0.

    A-Z is lower-cased and words are split at the contract's whitespace (``bytes.lower``
    and ``bytes.split`` do just that).  A bit is set if more than half of the shingles'
    XXH64 values have it.  Fewer words than a shingle form one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    bits, total = np.zeros(64, np.int64), 0
    while block := list(islice(shingles, BLOCK)):
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in block), "<u8", len(block))
        rows = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += rows.sum(axis=0, dtype=np.int64)
        total += len(block)
    return int(np.packbits(bits * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """(doc_id, fp) of every row."""

    def rows(each: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in each:
            yield key, fingerprint(text, shingle, seed)

    return map_rows(
        docs,
        [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")],
        f"doc_id {type_of(docs, id_col)}, fp long",
        rows,
    )


def cell_of(bits: Column, width: int = WIDTH) -> Column:
    """The packed vector of bit counts of 16 segments of ``width`` bits, each plus one."""
    key = F.lit(0).cast("long")
    for i in range(SEGMENTS):
        count = F.bit_count(F.shiftrightunsigned(bits, i * width).bitwiseAND(F.lit((1 << width) - 1)))
        key = key + (count + 1).cast("long") * (1 << (FIELD * i))
    return key


def near_pairs(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) that differ in one or two bits."""
    return _grid_join(fps.select("fp", cell_of(F.col("fp")).alias("cell")), 2)


def _grid_join(cells: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of fingerprints (fp) within ``radius`` bits whose cells are within distance two.

    Fingerprints with the same ``root`` (a column that may be there, and null) are connected
    already and give no pair.

    With unit steps e_i, two cells within distance two are equal, or one is the other
    plus e_i, or they differ by e_i + e_j (i <= j) or e_i - e_j (i < j), up to exchange.
    The left side goes to its own cell and to every cell + e_i; the right side to its
    own cell and to every cell - e_j and + e_j.  Each case is accepted in one meeting
    cell only, so every pair comes out once.

    Spark sizes each side as before its rows are copied (17 and 34 times), so left to its
    estimate it would collect one of them on the driver.  Both are shuffled instead.
    """
    step = [1 << (FIELD * i) for i in range(SEGMENTS)]
    moved = 1 << 62  # keeps the meetings of unmoved left rows apart from those of moved ones

    def sent(side: str, targets: list[tuple[int, int, int]]) -> DataFrame:
        places = F.array(
            *[
                F.struct(
                    (F.col("cell") + F.lit(delta)).alias("cell"),
                    F.lit(sign).cast("byte").alias(f"{side}_sign"),
                    F.lit(i).cast("byte").alias(f"{side}_i"),
                )
                for delta, sign, i in targets
            ]
        )
        known = [F.col("root").alias(f"{side}_root")] if "root" in cells.columns else []
        return cells.select(F.col("fp").alias(side), "cell", *known).select(
            side, *[f"{side}_root" for _ in known], F.inline(places)
        )

    left = sent("a", [(0, 0, 0), *[(moved + s, 1, i) for i, s in enumerate(step)]])
    right = sent(
        "b",
        [
            (0, 0, 0),
            (moved, 0, 0),
            *[(moved - s, -1, i) for i, s in enumerate(step)],
            *[(moved + s, 1, i) for i, s in enumerate(step)],
        ],
    )
    once = (
        F.when((F.col("a_sign") == 0), F.col("a") < F.col("b"))
        .when(F.col("b_sign") == 0, F.lit(True))
        .when(F.col("b_sign") < 0, F.col("a_i") <= F.col("b_i"))
        .otherwise(F.col("a_i") < F.col("b_i"))
    )
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    if "root" in cells.columns:
        close = F.coalesce(F.col("a_root") != F.col("b_root"), F.lit(True)) & close
    met = left.withColumnRenamed("cell", "a_cell").join(
        right.hint("merge"), (F.col("a_cell") == F.col("cell")) & close & once
    )
    return met.select("a", "b")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Documents are linked when their fingerprints differ in two bits or fewer, and
    component_id is the smallest id reachable by links.  Null and blank texts have
    fingerprint zero and are linked like any other.  A null id counts only if a group
    has no other.  Repeated rows belong to the same component.  An empty table gives no
    rows; other columns are ignored.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle, seed), "fps")
    groups = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "groups")
    links = stored(near_pairs(groups.select("fp")), "pairs")
    roots = stored(
        components(links).join(groups, F.col("node") == F.col("fp")).select("fp", "root", "lowest"),
        "roots",
    )
    named = roots.groupBy("root").agg(F.min("lowest").alias("component_id"))
    linked = roots.join(named, "root").select("fp", "component_id")
    whole = stored(
        groups.join(linked, "fp", "left").select(
            "fp", F.coalesce("component_id", "lowest").alias("component_id")
        ),
        "whole",
    )
    return fps.join(whole, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _differ(a: Column, b: Column, views: int) -> Column:
    """Bits in which two lists of fingerprints differ."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(views)), F.lit(0))


def _leaders(members: DataFrame, views: int, limit: int) -> DataFrame:
    """Per (view, half): the leaders of a group's nodes, and the links to them.

    In ascending order, a node within ``limit`` bits of a leader, over all its
    fingerprints, gives way to it, and any other becomes a leader.  Each node that gives
    way is linked to every leader so near, so a group never gives all its pairs.
    """

    def near(a: Column, b: Column) -> Column:
        return _differ(a["fps"], b["fps"], views) <= limit

    def step(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda led: near(led, x)), acc).otherwise(F.concat(acc, F.array(x)))

    def with_links(leaders: Column) -> Column:
        def to_leaders(x: Column) -> Column:
            found = F.filter(leaders, lambda led: (led["node"] != x["node"]) & near(led, x))
            return F.transform(found, lambda led: F.struct(led["node"].alias("a"), x["node"].alias("b")))

        return F.struct(leaders.alias("leaders"), F.flatten(F.transform("nodes", to_leaders)).alias("links"))

    start = F.array().cast("array<struct<node:bigint,fps:array<bigint>>>")
    keys = [c for c in members.columns if c not in ("node", "fps")]
    # as the only element of an array the leaders are computed once for all nodes
    met = F.element_at(F.transform(F.array(F.aggregate("nodes", start, step)), with_links), 1)
    return (
        members.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("node", "fps"))).alias("nodes"))
        .select("view", "half", met.alias("met"))
    )


def _between_roots(members: DataFrame, views: int, limit: int) -> DataFrame:
    """Links (a, b) between nodes of one (view, half) that are not connected yet.

    A group whose nodes all have one root has none.  In the others, the nodes outside the
    most frequent root are compared with all nodes of another root, block by block.
    """
    group = ["view", "half"]
    per_root = members.groupBy(*group, "root").agg(F.count("node").alias("n"))
    mixed = stored(
        per_root.groupBy(*group)
        .agg(F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("most"), F.max("n").alias("n_most"))
        .filter("n > n_most"),
        "mixed",
    )
    blocks = F.ceil(F.col("n") / FOLD).cast("int")
    few_blocks = F.ceil((F.col("n") - F.col("n_most")) / FOLD).cast("int")
    rows = stored(members.join(mixed, group), "unlike")
    own = F.xxhash64("node")
    left = rows.filter("root != most").select(
        *group, F.col("node").alias("a"), F.col("fps").alias("fa"), F.col("root").alias("ra"),
        F.pmod(own, few_blocks).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"),
    )
    right = rows.select(
        *group, F.col("node").alias("b"), F.col("fps").alias("fb"), F.col("root").alias("rb"), (F.col("root") == F.col("most")).alias("many"),
        F.pmod(own, blocks).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), few_blocks - 1)).alias("i"),
    )
    once = (F.col("ra") != F.col("rb")) & (F.col("many") | (F.col("a") < F.col("b")))
    same = [left[c] == right[c] for c in (*group, "i", "j")]
    close = _differ(F.col("fa"), F.col("fb"), views) <= limit
    # rows are copied once a block, which Spark's estimate of their size leaves out
    return left.join(right.hint("merge"), same[0] & same[1] & same[2] & same[3] & once & close).select("a", "b")


def wide_links(fps: DataFrame, radius: int = WIDE_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) up to ``radius`` (at most five) bits."""
    return node_links(fps.select(F.col("fp").alias("node"), F.array("fp").alias("fps")), 0, 1, radius)


def node_links(nodes: DataFrame, at: int | Sequence[int], views: int, limit: int, radius: int = WIDE_BITS) -> DataFrame:
    """Links (a, b) between nodes (node, fps) up to ``limit`` bits over all ``views`` fingerprints.

    Nodes are compared if they share a half of fingerprint ``at`` or differ in at most
    ``radius`` (at most five) of its bits; of several fingerprints, if they do so in one.  Of
    five differing bits, one 32-bit half holds two at most, so both halves are joined through
    the popcount grid of their 2-bit segments.  First the leaders of each half connect most of a group of near copies by a
    number of links in proportion to its size.  Then all nodes that this has not connected
    are compared, those that gave way to a leader as well, so the links connect whatever
    all pairs within the limit connect; they are not all pairs.  All fingerprints take
    the rounds together, and the grid, the largest shuffle, one at a time.
    """
    at = [at] if isinstance(at, int) else list(at)

    def half(i: int, low: bool) -> Column:
        fp = F.col("fps")[i]
        bits = fp.bitwiseAND(F.lit(0xFFFFFFFF)) if low else F.shiftrightunsigned(fp, 32)
        return F.struct(F.lit(2 * i + (not low)).cast("long").alias("view"), bits.alias("half"))

    halves = F.explode(F.array(*[half(i, low) for i in at for low in (True, False)])).alias("h")
    everyone = stored(nodes.select("node", "fps", halves).select("node", "fps", "h.view", "h.half"), "halves")
    members, links, before = everyone, [], {}
    while True:
        # groups of many members are split, and their leaders meet in the next round
        sizes = members.groupBy("view", "half").agg(F.count("node").alias("n")).filter(f"n > {FOLD}")
        crowded = stored(sizes, "crowded")
        largest = {r["view"]: r["n"] for r in crowded.groupBy("view").agg(F.max("n").alias("n")).collect()}
        # crowds of unlike nodes are left, since leaders do not thin them out
        stuck = [view for view, n in largest.items() if 2 * n > before.get(view, 2 * n)]
        split = members.filter(~F.col("view").isin(stuck)) if stuck else members
        before = {view: n for view, n in largest.items() if view not in stuck}
        if before:
            parts = F.ceil(F.coalesce("n", F.lit(1)) / (FOLD // 2))
            split = split.join(crowded, ["view", "half"], "left").select(
                "node", "fps", "view", "half", F.pmod(F.xxhash64("node"), parts).alias("part")
            )
        met = stored(_leaders(split, views, limit), "leaders")
        links.append(met.select(F.inline("met.links")))
        if not before:
            break
        leaders = met.select(F.explode("met.leaders").alias("led"), "view", "half").select("led.*", "view", "half")
        members = leaders.join(crowded, ["view", "half"], "left_semi")
    links = [stored(union_all(links).distinct(), "led")]
    everyone = stored(everyone.join(components(links[0]), "node", "left"), "rooted")
    between = _between_roots(everyone.withColumn("root", F.coalesce("root", "node")), views, limit)
    links.append(stored(between, "between"))
    # a fingerprint has a root if all its nodes have that one; a node without links has none
    same = (F.count("root") == F.count("node")) & (F.min("root") == F.max("root"))
    for i in at:
        fp = F.col("fps")[i]
        cells = everyone.filter(F.col("view").isin(2 * i, 2 * i + 1)).withColumn("fp", fp)
        cells = cells.withColumn("cell", cell_of(F.col("half"), 2) + F.pmod("view", F.lit(2)) * (1 << 50))
        cells = cells.groupBy("fp", "cell").agg(F.when(same, F.min("root")).alias("root"))
        holders = nodes.select(fp.alias("fp"), "node", "fps")
        a = holders.select(F.col("fp").alias("a"), F.col("node").alias("na"), F.col("fps").alias("fa"))
        b = holders.select(F.col("fp").alias("b"), F.col("node").alias("nb"), F.col("fps").alias("fb"))
        close = _differ(F.col("fa"), F.col("fb"), views) <= limit
        near = _grid_join(cells, radius).join(a, "a")
        met = near.join(b, (near["b"] == b["b"]) & close).select(F.col("na").alias("a"), F.col("nb").alias("b"))
        links.append(stored(met, "near"))
    return union_all(links)


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = NEAR_SHINGLE,
    seeds: tuple[int, ...] = (42, 43, 44),
    radius: int = WIDE_BITS,
    share: float = WIDE_SHARE,
) -> DataFrame:
    """One row per input row: doc_id, component_id (the smallest id of the group).

    The wider form of ``simhash_groups`` for removing near copies, with one fingerprint
    per seed.  Pairs of which one fingerprint differs in ``radius`` bits or fewer, or
    shares a half, are compared by all of them, and linked if at most ``share`` of the bits differ.
    Fingerprints over shingles of two words link nine in ten pairs with a similarity of 0.8
    or more on shingles of five, and hardly any below 0.6.
    Blank texts are linked to each other.  Nulls, repeated rows and empty tables are
    treated as there.
    """

    return _near_rows(docs, id_col, text_col, shingle, seeds, radius, share).select("doc_id", "component_id")


def _near_rows(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    shingle: int = NEAR_SHINGLE,
    seeds: tuple[int, ...] = (42, 43, 44),
    radius: int = WIDE_BITS,
    share: float = WIDE_SHARE,
) -> DataFrame:
    """One row per input row: doc_id, row_hash (of the text), component_id, stays.

    ``stays`` marks the row whose id gives the group its id; of several texts of that id
    in one group, the one with the smallest hash.  Rows that repeat both are marked alike.
    """

    def rows(each: Iterable[tuple]) -> Iterator[tuple]:
        for key, text, row_hash in each:
            yield key, row_hash, [fingerprint(text, shingle, seed) for seed in seeds]

    found = stored(
        map_rows(
            docs,
            [
                F.col(id_col).alias("doc_id"),
                F.col(text_col).cast("string").alias("text"),
                F.xxhash64(text_of(docs, text_col)).alias("row_hash"),
            ],
            f"doc_id {type_of(docs, id_col)}, row_hash long, fps array<long>",
            rows,
        ),
        "fps",
    )
    # a node is a distinct list of fingerprints; a null id comes after all others
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")
    nodes = stored(
        found.groupBy("fps").agg(F.min(row).alias("lowest")).withColumn("node", F.monotonically_increasing_id()), "nodes"
    )
    views = len(seeds)
    limit = int(share * 64 * views)
    links = node_links(nodes.select("node", "fps"), range(views), views, limit, radius)
    roots = stored(components(links), "roots").withColumnRenamed("node", "_node")
    linked = nodes.join(roots, F.col("node") == F.col("_node")).select("node", "root", "lowest")
    named = linked.groupBy("root").agg(F.min("lowest").alias("first"))
    whole = stored(
        nodes.join(linked.join(named, "root").select("node", "first"), "node", "left").select(
            "fps", F.coalesce("first", "lowest").alias("first")
        ),
        "whole",
    )
    first = F.col("first")
    return found.join(whole, "fps").select(
        "doc_id",
        "row_hash",
        first["doc_id"].alias("component_id"),
        (F.col("doc_id").eqNullSafe(first["doc_id"]) & (F.col("row_hash") == first["row_hash"])).alias("stays"),
    )


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of every group of ``near_groups``, all columns unchanged.

    The document that gives the group its id stays.  Rows are told apart by id and text,
    so a null id or one with several texts is decided text by text; of rows that repeat
    both, one stays.
    """
    result = stored(_near_rows(docs, id_col, text_col), "near")
    key, other, own = (fresh(docs, name) for name in ("key", "other", "row_hash"))

    def pairs(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("doc_id").alias(key), F.col("row_hash").alias(other)).distinct()

    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(own) == F.col(other))
    hashed = docs.withColumn(own, F.xxhash64(text_of(docs, text_col)))
    kept = hashed.join(pairs(result.filter("not stays")), same, "left_anti")
    repeated = result.filter("stays").groupBy("doc_id", "row_hash").count().filter("count > 1")
    if not repeated.isEmpty():
        kept = kept.join(pairs(repeated), same, "left_anti").unionByName(
            hashed.join(pairs(repeated), same, "left_semi").dropDuplicates([id_col, own])
        )
    return kept.drop(own)
