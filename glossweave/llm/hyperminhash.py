"""Near duplicates by HyperMinHash registers, banding and exact verification.

A document is the set of its distinct shingles.  Its sketch has 256 buckets; a shingle's
hash names the bucket, and the bucket keeps the smallest rest of all hashes it got, as a
number of leading zeros and ten bits of mantissa.  An empty bucket borrows from the first
filled one in an order of its own, so short texts have whole sketches too.  Two documents
agree in a register with a probability equal to their similarity, apart from collisions of
unequal rests, for which the estimate is corrected.

Bands of six registers propose pairs.  In each band the members meet their smallest
member first.  Members of a band that are not connected by then meet each other in blocks;
a pair is looked at in the first band it shares only, and not if its members have become
connected in the task, so a block gives fewer links than it has members.  Pairs whose
estimate is high enough are verified on the whole sets, as 64-bit hashes of all shingles,
and only verified links count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from glossweave.llm.common import map_rows, text_of, type_of
from glossweave.llm.graph import components
from glossweave.session import stored

REGISTERS, MANTISSA = 256, 10
#: 42 bands of 6 registers: a pair of similarity 0.8 shares one with a probability of 0.999997.
BANDS, ROWS = 42, 6
#: An estimate may fall short of the similarity by this much, four times its deviation for
#: sets of ``LARGE`` shingles; smaller sets also lose shingles that share a bucket.
SLACK, SMALL_SLACK, LARGE = 0.1, 0.15, 256
#: Members of a band compared as one block.
BLOCK = 500


def shingle_set(text: str | None, shingle: int = 2) -> set[bytes]:
    """Distinct shingles of a text, A-Z lower-cased; fewer words form one, no words none.

    ``bytes.lower`` and ``bytes.split`` know just the contract's letters and whitespace.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if 0 < len(words) <= shingle:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))


@lru_cache(1)
def _orders() -> np.ndarray:
    """For each bucket, the order in which it asks the others when it is empty."""
    marks = [xxhash.xxh64_intdigest(b"%d:%d" % (i, j)) for i in range(REGISTERS) for j in range(REGISTERS)]
    return np.argsort(np.array(marks, np.uint64).reshape(REGISTERS, REGISTERS), axis=1)


def hashed(shingles: Iterable[bytes], seed: int = 0) -> np.ndarray:
    """The hashes of a set's shingles in ascending order."""
    hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], np.uint64)
    hashes.sort()
    return hashes


def similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether two sets of hashes have a similarity of ``percent`` / 100 or more."""
    if 100 * min(len(left), len(right)) < percent * max(len(left), len(right)):
        return False
    at = np.searchsorted(left, right)
    common = int((left[np.minimum(at, len(left) - 1)] == right).sum())
    return 100 * common >= percent * (len(left) + len(right) - common)


def sketch(shingles: Iterable[bytes], seed: int = 0) -> np.ndarray:
    """The registers of a set that is not empty: leading zeros plus one, then the mantissa."""
    hashes = hashed(shingles, seed)
    bucket, first = np.unique((hashes >> np.uint64(56)).astype(np.int64), return_index=True)
    rest = ((hashes[first] & np.uint64((1 << 56) - 1)) >> np.uint64(3)).astype(np.float64)
    fraction, length = np.frexp(rest)  # 53 bits are exact in a double
    mantissa = np.maximum(fraction * 2 - 1, 0) * (1 << MANTISSA)
    filled = np.zeros(REGISTERS, np.uint16)
    filled[bucket] = ((54 - length).astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)
    empty = np.flatnonzero(filled == 0)
    if len(empty):
        asked = _orders()[empty]
        filled[empty] = filled[asked[np.arange(len(empty)), np.argmax(filled[asked] > 0, axis=1)]]
    return filled


def band_keys(registers: bytes) -> list[int]:
    """One signed key per band of registers."""
    width = 2 * ROWS
    keys = (xxhash.xxh64_intdigest(registers[i * width : (i + 1) * width], i) for i in range(BANDS))
    return [k - (1 << 64) if k >> 63 else k for k in keys]


@lru_cache(1)
def _chances() -> np.ndarray:
    """Probability that registers of unequal rests agree, by log2 of the shingles per bucket."""
    zeros, steps = np.arange(40.0)[:, None], np.arange(1 << MANTISSA)[None, :]
    edge = np.ldexp(1 + steps / (1 << MANTISSA), -(zeros.astype(int) + 1))
    width = np.ldexp(1.0 / (1 << MANTISSA), -(zeros.astype(int) + 1))
    cells = [((1 - edge) ** (2.0**c) - np.maximum(1 - edge - width, 0) ** (2.0**c)).ravel() for c in range(21)]
    cells = np.array(cells)
    return cells @ cells.T


def _load(sizes: np.ndarray) -> np.ndarray:
    """log2 of the shingles per filled bucket, rounded."""
    return np.clip(np.rint(np.log2(np.maximum(sizes / REGISTERS, 1))), 0, 20).astype(int)


def estimate(left: np.ndarray, right: np.ndarray, left_sizes: np.ndarray, right_sizes: np.ndarray) -> np.ndarray:
    """Similarities of sketches row by row, corrected for registers that agree by chance."""
    agree = (left == right).mean(axis=-1)
    chance = _chances()[_load(left_sizes), _load(right_sizes)]
    return (agree - chance) / (1 - chance)


def likely(estimates: np.ndarray, left_sizes: np.ndarray, right_sizes: np.ndarray, share: float) -> np.ndarray:
    """Whether pairs with these estimates may be as similar as ``share``."""
    slack = np.where(np.minimum(left_sizes, right_sizes) < LARGE, SMALL_SLACK, SLACK)
    return estimates >= share - slack


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2) -> DataFrame:
    """(doc_id, row_hash, n_shingles, digest, registers); the last two are null for an empty set.

    ``digest`` are 16 bytes of BLAKE2b over the sorted shingles and stands for the set.
    """

    def rows(each: Iterable[tuple]) -> Iterator[tuple]:
        for key, text, row_hash in each:
            found = shingle_set(text, shingle)
            if found:
                yield key, row_hash, len(found), _digest(found), sketch(found).tobytes()
            else:
                yield key, row_hash, 0, None, None

    return map_rows(
        docs,
        _texts(docs, id_col, text_col),
        f"doc_id {type_of(docs, id_col)}, row_hash long, n_shingles long, digest binary, registers binary",
        rows,
    )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> list:
    whole = F.xxhash64(text_of(docs, text_col))
    return [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), whole.alias("row_hash")]


def _digest(shingles: set[bytes]) -> bytes:
    return hashlib.blake2b(b"\n".join(sorted(shingles)), digest_size=16).digest()


def _likely(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) of nodes whose estimate allows a similarity of ``share``."""

    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("registers").alias(f"r{name}"), F.col("n").alias(f"n{name}"))

    def rows(each: Iterable[tuple]) -> Iterator[tuple]:
        for a, b, ra, rb, na, nb in each:
            close = estimate(np.frombuffer(ra, np.uint16), np.frombuffer(rb, np.uint16), np.array(na), np.array(nb))
            if likely(close, na, nb, share):
                yield a, b

    met = pairs.join(side("b"), "b").join(side("a"), "a")
    return map_rows(met, [F.col(c) for c in ("a", "b", "ra", "rb", "na", "nb")], "a long, b long", rows)


def _hashes(
    nodes: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int
) -> DataFrame:
    """(node, hashes) of the whole sets of ``nodes``, from the text of one row of each."""
    need = nodes.join(sets, "node").select(
        "node", F.col("lowest.doc_id").alias("_id"), F.col("lowest.row_hash").alias("_hash"), F.col("digest").alias("_digest")
    )
    rows = docs.select(*_texts(docs, id_col, text_col))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash"))

    def own(each: Iterable[tuple]) -> Iterator[tuple]:
        for node, digest, text in each:
            found = shingle_set(text, shingle)
            if _digest(found) == digest:
                yield node, hashed(found).tobytes()

    met = rows.join(need, same)
    found = map_rows(met, [F.col(c) for c in ("node", "_digest", "text")], "node long, hashes binary", own)
    return found.groupBy("node").agg(F.first("hashes").alias("hashes"))


def _verified(pairs: DataFrame, hashes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""

    def check(each: Iterable[tuple]) -> Iterator[tuple]:
        for a, b, first, second in each:
            if similar(np.frombuffer(first, np.uint64), np.frombuffer(second, np.uint64), percent):
                yield a, b

    b = hashes.select(F.col("node").alias("b"), F.col("hashes").alias("_second"))
    a = hashes.select(F.col("node").alias("a"), F.col("hashes").alias("_first"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "_first", "_second")
    return map_rows(both, [F.col(c) for c in both.columns], "a long, b long", check)


def _first_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first band in which each row of ``left`` agrees with ``right``; they share one."""
    width = BANDS * ROWS
    equal = (left[:, :width] == right[:width]).reshape(len(left), BANDS, ROWS)
    return equal.all(axis=2).argmax(axis=1)


def _apart(mixed: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) between members of one band that are not connected yet.

    ``mixed`` has rows (key, band, node, root, n_band, registers, n, hashes).  A band is cut into
    blocks, and each pair of blocks is compared by one task.  Likelier pairs come first;
    members that a link connects count as one from then on.
    """
    blocks = F.ceil(F.col("n_band") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = mixed.withColumn("own", own).select(
        "*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    ).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root",
        "registers", "n", "band", "hashes",
    )
    met = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "node")

    def compare(each: Iterable[tuple]) -> Iterator[tuple]:
        for (_, i, j), group in groupby(each, key=lambda r: r[:3]):
            held = list(group)
            owner, node, root, n = (np.array([r[c] for r in held]) for c in (3, 4, 5, 7))
            if (root == root[0]).all():
                continue
            registers = np.frombuffer(b"".join(r[6] for r in held), np.uint16).reshape(len(held), REGISTERS)
            pairs = []
            for x in np.flatnonzero(owner == i):
                y = np.flatnonzero((owner == j) & (root != root[x]) & ((node > node[x]) | (i != j)))
                if not len(y):
                    continue
                close = estimate(registers[y], registers[x], n[y], n[x])
                good = likely(close, n[y], n[x], percent / 100)
                good[good] = _first_shared(registers[y[good]], registers[x]) == held[x][8]
                pairs += zip(close[good].tolist(), [int(x)] * int(good.sum()), y[good].tolist())
            yield from _connect(pairs, node, root, [r[9] for r in held], percent)

    return map_rows(met, [F.col(c) for c in met.columns], "a long, b long", compare)


def _connect(pairs: list[tuple], node: np.ndarray, root: np.ndarray, hashes: list[bytes], percent: int) -> Iterator[tuple]:
    """Of (estimate, x, y), the verified pairs whose members no earlier one has connected."""
    up: dict[int, int] = {}

    def find(r: int) -> int:
        while (above := up.get(r, r)) != r:
            up[r] = up.get(above, above)
            r = above
        return r

    sets: dict[int, np.ndarray] = {}
    for _, x, y in sorted(pairs, reverse=True):
        a, b = find(int(root[x])), find(int(root[y]))
        if a == b:
            continue
        left, right = (sets.setdefault(z, np.frombuffer(hashes[z], np.uint64)) for z in (x, y))
        if similar(left, right, percent):
            up[a] = b
            yield int(node[x]), int(node[y])


def similarity_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, percent: int = 80
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 times the size of the intersection of their sets is at
    least ``percent`` times that of the union, and component_id is the smallest id
    reachable by links.  A document without words is linked with nothing and stands for
    itself, as does a null text.  A null id gives a component its id only if there is no
    other.  Repeated rows belong to one component and are marked alike.  Texts are
    read whole; a task holds one text, or the hashes of a block's sets.  An empty table gives no rows;
    other columns are ignored.
    """
    found = stored(sketches(docs, id_col, text_col, shingle), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")
    sets = stored(
        found.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(F.min(row).alias("lowest"), F.min("n_shingles").alias("n"), F.first("registers").alias("registers"))
        .withColumn("node", F.monotonically_increasing_id()),
        "sets",
    )

    def keys(each: Iterable[tuple]) -> Iterator[tuple]:
        for node, registers in each:
            yield node, band_keys(registers)

    bands = stored(map_rows(sets, [F.col("node"), F.col("registers")], "node long, keys array<long>", keys), "bands")
    members = bands.select("node", F.posexplode("keys").alias("band", "key"))
    sizes = members.groupBy("key").agg(F.min("node").alias("lead"), F.count("node").alias("n_band")).filter("n_band > 1")
    met = stored(members.join(sizes, "key").select("key", "band", "node", "lead", "n_band"), "met")
    hashes = stored(_hashes(met.select("node").distinct(), sets, docs, id_col, text_col, shingle), "hashes")
    stars = met.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(_verified(_likely(stars, sets, percent / 100), hashes, percent), "links")
    roots = stored(components(links).withColumnRenamed("node", "_node"), "roots")
    # bands of more than two members that are not all connected
    placed = met.filter("n_band > 2").join(roots, F.col("node") == F.col("_node"), "left")
    placed = stored(placed.select("key", "band", "node", "n_band", F.coalesce("root", "node").alias("root")), "placed")
    open_bands = placed.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo < _hi")
    mixed = (
        placed.join(open_bands.select("key"), "key", "left_semi")
        .join(sets.select("node", "registers", "n"), "node")
        .join(hashes, "node")
    )
    added = stored(_apart(mixed, percent), "links")
    if not added.isEmpty():
        roots = stored(components(links.unionByName(added)).withColumnRenamed("node", "_node"), "roots")
    linked = sets.join(roots, F.col("node") == F.col("_node"), "left").select(
        "digest", "lowest", F.coalesce("root", "node").alias("root")
    )
    named = linked.groupBy("root").agg(F.min("lowest").alias("first"))
    whole = stored(linked.join(named, "root").select("digest", F.col("first.doc_id").alias("_component")), "whole")
    component = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    return found.join(whole, "digest", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
