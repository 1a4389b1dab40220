"""Range join of boxes of all sizes on a grid with levels.

A box lives on the level whose cells are just as large as its longer side, so it touches
four cells at most, whether it is one pixel or a hundred thousand wide.  Two boxes meet on
the level of the larger one: there the smaller one is a visitor, in four cells at most as
well.  Visitors never meet each other.  A box is therefore sent to at most four cells
for each level that occurs in the data.

Cells that hold many boxes are cut: both sides are dealt into groups by hash, and each pair
of groups is a key of its own, so a cell with a third of all rows is spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from glossweave.session import stored

#: Side of the smallest cells; level l has cells of ``BASE << l``.
BASE = 128
TOP_LEVEL = 40
#: Boxes of one side that one key of a crowded cell holds, about.
CROWD = 2_000


def level_of(base: int = BASE) -> Column:
    """The lowest level whose cells are not smaller than the box."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    level = F.ceil(F.log2(side / F.lit(base)))
    return F.least(F.greatest(F.coalesce(level, F.lit(0)), F.lit(0)), F.lit(TOP_LEVEL)).cast("int")


def _placed(df: DataFrame, on: Sequence[str], prefix: str, present: list[int], base: int, kinds: tuple) -> DataFrame:
    """Rows of a side in every cell they are sent to; ``kinds`` of residents and of visitors.

    ``present`` are the levels of the other side.  A box visits those above its own, and is
    at home only if the other side has a box as small as itself, or smaller, to meet there.
    """
    level, size = F.col("_level"), F.call_function("shiftleft", F.lit(base).cast("long"), F.col("_at"))
    home = F.when(level >= min(present), F.array(level)).otherwise(F.array().cast("array<int>"))
    upward = F.concat(home, F.filter(F.array(*[F.lit(x) for x in present]), lambda x: x > level))
    cells = [F.sequence(F.floor(F.col(f"{a}0") / size), F.floor(F.col(f"{a}1") / size)) for a in ("x", "y")]
    resident, visitor = (F.array(*[F.lit(k) for k in ks]) for ks in kinds)
    return (
        df.withColumn("_level", level_of(base))
        .withColumn("_at", F.explode(upward))
        .withColumn("_cx", F.explode(cells[0]))
        .withColumn("_cy", F.explode(cells[1]))
        .withColumn("_kind", F.explode(F.when(F.col("_at") == level, resident).otherwise(visitor)))
        .select(*on, "_at", "_cx", "_cy", "_kind", *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in on])
    )


def level_join(
    left: DataFrame, right: DataFrame, on: Sequence[str] = ("page",), base: int = BASE, crowd: int = CROWD
) -> DataFrame:
    """Pairs of boxes with a positive overlap; columns get prefixes ``a_`` and ``b_``.

    The same pairs as ``grid_join``, each once.  The levels that occur and the crowded cells
    are looked up first, in two passes over the boxes.  Boxes with a null side meet nothing.
    """
    on = list(on)
    sides = [side.select(level_of(base).alias("l"), F.lit(i).alias("side")) for i, side in enumerate((left, right))]
    found = sides[0].unionByName(sides[1]).distinct().limit(2 * (TOP_LEVEL + 1)).collect()
    ours, theirs = (sorted(r["l"] for r in found if r["side"] == i) or [0] for i in (0, 1))
    # kind 0: residents of the left side with everything; kind 1: its visitors with residents
    a = _placed(left, on, "a_", theirs, base, ((0,), (1,)))
    b = _placed(right, on, "b_", ours, base, ((0, 1), (0,)))
    keys = [*on, "_at", "_cx", "_cy", "_kind"]
    sizes = _sizes(a, None if right is left else _placed(right, on, "b_", ours, base, ((0,), (1,))), keys)
    product = F.col("_na").cast("double") * F.col("_nb")
    crowded = stored(sizes.filter(product > float(crowd) * crowd), "crowded")
    if not crowded.isEmpty():
        groups = crowded.select(
            *keys, *[F.ceil(F.col(n) / crowd).cast("int").alias(g) for n, g in (("_na", "_ga"), ("_nb", "_gb"))]
        )
        a, b = (_dealt(side, groups, keys, own, other) for side, own, other in ((a, "_ga", "_gb"), (b, "_gb", "_ga")))
        keys = [*keys, "_ga", "_gb"]
    size = F.call_function("shiftleft", F.lit(base).cast("long"), F.col("_at"))
    corner_x, corner_y = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    return (
        a.join(b, keys)
        .filter(
            (F.col("a_x0") < F.col("b_x1"))
            & (F.col("b_x0") < F.col("a_x1"))
            & (F.col("a_y0") < F.col("b_y1"))
            & (F.col("b_y0") < F.col("a_y1"))
            & (F.floor(corner_x / size) == F.col("_cx"))
            & (F.floor(corner_y / size) == F.col("_cy"))
        )
        .drop(*[k for k in keys if k not in on])
    )


def _sizes(left: DataFrame, right: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows of both sides for each key, from one count of residents and visitors a cell; no right side is the left again."""
    cell = keys[:-1]

    def counted(side: DataFrame, residents: str, visitors: str) -> DataFrame:
        return side.groupBy(*cell).agg(*[F.count_if(F.col("_kind") == k).alias(n) for k, n in ((0, residents), (1, visitors))])

    both = counted(left, "_ra", "_va")
    if right is None:
        both = both.withColumns({"_rb": F.col("_ra"), "_vb": F.col("_va")})
    else:
        both = both.join(counted(right, "_rb", "_vb"), cell)
    at_home = F.col("_kind") == 0
    return both.withColumn("_kind", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        *keys,
        F.when(at_home, F.col("_ra")).otherwise(F.col("_va")).alias("_na"),
        F.when(at_home, F.col("_rb") + F.col("_vb")).otherwise(F.col("_rb")).alias("_nb"),
    )


def _dealt(side: DataFrame, groups: DataFrame, keys: list[str], own: str, other: str) -> DataFrame:
    """A side's rows with a group of their own and one copy for each group of the other side."""
    columns = [c for c in side.columns if c not in keys]
    met = side.join(groups, keys, "left")
    mine = F.pmod(F.xxhash64(*columns), F.coalesce(own, F.lit(1))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
    return met.withColumn("_mine", mine).withColumn("_others", others).select(
        *keys, *columns, F.col("_mine").alias(own), F.col("_others").alias(other)
    )
