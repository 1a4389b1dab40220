"""Partitioning of weighted tuples into narrow groups of at least k rows.

Groups of many tuples are cut into thousands of parts at once, by a tree of cuts found on a
sample and checked by exact counts; a part that fits a task is then cut to the end there.
So a table takes one round or two, not one for each halving.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glossweave.session import stored

#: Tuples that one task cuts to the end.
LOCAL = 50_000
#: Tuples of a larger group that its tree of cuts is found on, about, and the fewest a leaf may hold.
SAMPLE, LEAF = 200_000, 40


def _ranges(low: np.ndarray, high: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Ranges as a share of the table's; nulls beside values make them wider than any."""
    with np.errstate(invalid="ignore"):
        return np.nan_to_num((high - low) / whole, nan=0.0, posinf=2.0).sum(axis=1)


def _cut(x: np.ndarray, n: np.ndarray, k: float, whole: np.ndarray, least: float = 0.0) -> tuple[int, float] | None:
    """The column and the value up to which rows go left, so that both sides' ranges are narrowest.

    Both sides keep ``k`` rows and the share ``least`` of the tuples.  Cuts that leave room for as
    many groups as before go first; equal values stay together.
    """
    total, best, cost = n.sum(), None, np.inf
    for by in range(x.shape[1]):
        order = np.argsort(x[:, by], kind="stable")
        s, left = x[order], np.cumsum(n[order])[:-1]
        right = total - left
        tuples = np.arange(1, len(s))
        even = np.minimum(tuples, len(s) - tuples) >= len(s) * least
        fits = (s[1:, by] > s[:-1, by]) & (np.minimum(left, right) >= k) & even
        roomy = fits & (left // k + right // k == total // k)
        at = np.flatnonzero(roomy if roomy.any() else fits)
        if len(at):
            lows, highs = np.fmin.accumulate(s), np.maximum.accumulate(s)
            lows2, highs2 = np.fmin.accumulate(s[::-1])[::-1], np.maximum.accumulate(s[::-1])[::-1]
            both = left[at] * _ranges(lows[at], highs[at], whole) + right[at] * _ranges(lows2[at + 1], highs2[at + 1], whole)
            i = int(both.argmin())
            if best is None or both[i] < cost:
                best, cost = (by, float(s[at[i], by])), both[i]
    return best


def _matrix(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([table[c].to_numpy() for c in names])


def _groups(table: pa.Table, names: Sequence[str], k: int, whole: np.ndarray) -> pa.Table:
    """All tuples of one part with their group's size and ends."""
    x, n = _matrix(table, names), table["_n"].to_numpy()
    size, low, high = np.empty(len(n), "int64"), np.empty_like(x), np.empty_like(x)
    todo = [np.arange(len(n))]
    while todo:
        rows = todo.pop()
        cut = _cut(x[rows], n[rows], k, whole) if n[rows].sum() >= 2 * k else None
        if cut is None:
            size[rows], low[rows], high[rows] = n[rows].sum(), np.fmin.reduce(x[rows]), x[rows].max(axis=0)
        else:
            left = x[rows, cut[0]] <= cut[1]
            todo += [rows[left], rows[~left]]
    ends = {f"{c}_{e}": v[:, i] for i, c in enumerate(names) for e, v in (("lo", low), ("hi", high))}
    return pa.table({**{c: x[:, i] for i, c in enumerate(names)}, "_size": size, **ends})


def _tree(table: pa.Table, names: Sequence[str], k: int, whole: np.ndarray, local: int) -> pa.Table:
    """Cuts of one large group, found on its sample: node i goes on at ``_next[i]``, or one further beyond ``_at[i]``."""
    x, n = _matrix(table, names), table["_n"].to_numpy()
    each = table["_t"][0].as_py() / len(n)
    least_rows = max(k * n.sum() / table["_rows"][0].as_py(), 1e-9)
    by, at, following, depth = [-1], [0.0], [-1], [0]
    todo = [(0, np.arange(len(n)))]
    for node, rows in todo:
        if len(rows) * each <= local / 2 or len(rows) < 2 * LEAF:
            continue
        cut = _cut(x[rows], n[rows], least_rows, whole, 0.25)
        if cut is None:
            continue
        by[node], at[node], following[node] = *cut, len(by)
        left = x[rows, cut[0]] <= cut[1]
        todo += [(len(by), rows[left]), (len(by) + 1, rows[~left])]
        by, at, following, depth = by + [-1] * 2, at + [0.0] * 2, following + [-1] * 2, depth + [depth[node] + 1] * 2
    columns = {"_group": [table["_group"][0].as_py()], "_by": [by], "_at": [at], "_next": [following], "_deep": [max(depth) + 1]}
    return pa.table(columns, TREE)


TREE = pa.schema(
    [("_group", pa.string()), ("_by", pa.list_(pa.int32())), ("_at", pa.list_(pa.float64())), ("_next", pa.list_(pa.int32())), ("_deep", pa.int32())]
)


def _kept(counts: pa.Table, trees: pa.Table, k: int) -> pa.Table:
    """The node each leaf belongs to once cuts with fewer than ``k`` rows on a side are undone."""
    by, following = trees["_by"][0].as_py(), trees["_next"][0].as_py()
    rows = [0] * len(by)
    for node, n in zip(counts["_node"].to_pylist(), counts["_rows"].to_pylist()):
        rows[node] = n
    for i in reversed(range(len(by))):
        if by[i] >= 0:
            rows[i] = rows[following[i]] + rows[following[i] + 1]
    to = list(range(len(by)))
    for i, right in enumerate(following):
        if by[i] >= 0 and (to[i] != i or min(rows[right], rows[right + 1]) < k):
            to[right] = to[right + 1] = to[i]
    nodes = counts["_node"].to_pylist()
    return pa.table(
        {"_group": counts["_group"].to_pylist(), "_node": nodes, "_to": [to[i] for i in nodes]},
        pa.schema([("_group", pa.string()), ("_node", pa.int32()), ("_to", pa.int32())]),
    )


def narrow_groups(tuples: DataFrame, names: Sequence[str], widths: Sequence[float], k: int, local: int = LOCAL) -> DataFrame:
    """Distinct tuples (doubles, and ``_n`` rows each) with ``_size`` of their group and its ends, ``<name>_lo`` and ``_hi``.

    A group of more than ``local`` tuples whose cuts all fail the count stays whole.
    """
    names, whole = list(names), np.array(widths, float)
    live = tuples.select(*names, "_n", F.lit("").alias("_group"), F.lit(False).alias("_stuck"))
    small, final = [], []
    while True:
        sizes = stored(
            live.groupBy("_group").agg(F.count(F.lit(1)).alias("_t"), F.sum("_n").alias("_rows"), F.first("_stuck").alias("_whole")),
            "sizes",
        )
        fits, done = F.col("_t") <= local, F.col("_whole") | (F.col("_rows") < 2 * k)
        kinds = sizes.agg(*[F.count_if(c).alias(n) for n, c in (("big", ~fits & ~done), ("whole", ~fits & done))]).first()
        small.append(live if not any(kinds) else live.join(sizes.filter(fits).select("_group"), "_group"))
        if kinds["whole"]:
            final.append(live.join(sizes.filter(~fits & done).select("_group"), "_group"))
        if not kinds["big"]:
            break
        big = live.join(sizes.filter(~fits & ~done), "_group")
        drawn = F.pmod(F.xxhash64(F.lit("cuts"), *names), F.lit(1 << 24)) * F.col("_t") < F.lit(SAMPLE << 24)
        trees = stored(
            big.filter(drawn)
            .groupBy("_group")
            .applyInArrow(lambda t: _tree(t, names, k, whole, local), "_group string, _by array<int>, _at array<double>, _next array<int>, _deep int"),
            "trees",
        )
        values = F.array(*names)

        def step(node, _):
            beyond = F.get(values, F.get("_by", node)) > F.get("_at", node)
            return F.when(F.get("_by", node) < 0, node).otherwise(F.get("_next", node) + beyond.cast("int"))

        node = F.aggregate(F.sequence(F.lit(1), F.col("_deep")), F.lit(0), step)
        placed = stored(live.join(trees, "_group").select(*names, "_n", "_group", node.alias("_node")), "placed")
        kept = stored(
            placed.groupBy("_group", "_node").agg(F.sum("_n").alias("_rows"))
            .groupBy("_group").cogroup(trees.groupBy("_group"))
            .applyInArrow(lambda c, t: _kept(c, t, k), "_group string, _node int, _to int"),
            "kept",
        )
        live = placed.join(kept, ["_group", "_node"]).select(
            *names, "_n", F.concat_ws(".", "_group", "_to").alias("_group"), (F.col("_to") == 0).alias("_stuck")
        )
    ends = [f"{n}_{e}" for n in names for e in ("lo", "hi")]
    kind = ", ".join([*[f"{n} double" for n in names], "_size long", *[f"{e} double" for e in ends]])
    found = (
        reduce(DataFrame.unionByName, small).select(*names, "_n", "_group").groupBy("_group")
        .applyInArrow(lambda t: _groups(t, names, k, whole), kind)
    )
    for part in final:
        group = part.groupBy("_group").agg(
            F.sum("_n").alias("_size"), *[f(n).alias(f"{n}_{e}") for n in names for f, e in ((F.min, "lo"), (F.max, "hi"))]
        )
        found = found.unionByName(part.join(group, "_group").select(*names, "_size", *ends))
    return found
