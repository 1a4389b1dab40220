"""Window and range-join building blocks that survive a hot key.

A window partitioned by a key puts each key into one task.  The helpers here
split every key that holds more than ``limit`` rows into ordered chunks, run the
window inside the chunks and add what the earlier chunks carry over.  All rows
stay in the result.  Borders between chunks are rows of the key itself, compared
by the window's whole order, so any orderable types, nulls, ties and gaps give the
same result as the plain window.  Whether any key is that large is counted first,
in one pass over the key columns; without one the plan is the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from glossweave.session import stored

HOT_ROWS = 1_000_000
#: Chunks of one key, at most; above, chunks grow beyond ``limit`` rows.
MOST_CHUNKS = 10_000
#: Rows drawn per border.
DRAWN = 8


def spread(scan: DataFrame) -> DataFrame:
    """Split a scan that would leave more than half of the session's cores idle.

    One small file gives one task; costly text expressions then use one core.  A
    larger scan is left as it is, so nothing is shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() * 2 >= cores else scan.repartition(cores)


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS) -> DataFrame | None:
    """(keys, _n) of the keys with more than ``limit`` rows, or None if there is none.

    The counts are written to the shared folder; the planner decides by their size
    whether they may be broadcast.
    """
    hot = stored(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit), "hot"
    )
    return None if hot.isEmpty() else hot


def mark_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int = HOT_ROWS
) -> DataFrame | None:
    """Add ``_hot`` and ``_chunk`` (0 for other keys); None if no key is hot.

    ``order`` sorts ascending with nulls first; chunks follow it, and rows that tie in
    it share a chunk.  Rows drawn by hash serve as borders, about ``DRAWN`` for each
    chunk of ``limit`` rows, and are kept in two levels, so that a row is compared with
    some hundred borders at most.
    """
    hot = hot_keys(df, keys, limit)
    if hot is None:
        return None
    keys = list(keys)
    wanted = F.least(F.ceil(F.col("_n") / F.lit(max(1, limit))), F.lit(MOST_CHUNKS))
    drawn = (
        df.withColumn("_at", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
        .join(hot, keys)
        .filter(
            F.pmod(F.xxhash64("_at"), F.lit(1 << 30)) <= wanted * DRAWN / F.col("_n") * float(1 << 30)
        )
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("_at")).alias("_drawn"), F.max(wanted).cast("int").alias("_c"))
    )
    step = F.greatest(F.lit(1), F.floor(F.size("_drawn") / F.col("_c")).cast("int"))
    picked = drawn.select(
        *keys,
        F.transform(
            F.sequence(F.lit(1), F.ceil(F.size("_drawn") / step).cast("int")),
            lambda i: F.element_at("_drawn", ((i - 1) * step + 1).cast("int")),
        ).alias("_b"),
    ).withColumn("_m", F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("_b"))).cast("int")))
    groups = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_b") - 1) / F.col("_m")).cast("int")),
        lambda j: F.slice("_b", j * F.col("_m") + 1, F.col("_m")),
    )
    borders = stored(picked.select(*keys, "_m", groups.alias("_g")), "borders")

    def reached(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda n, b: n + (b <= F.col("_at")).cast("int"))

    outer = reached(F.transform("_g", lambda g: F.element_at(g, 1)))
    inner = reached(F.element_at("_g", F.col("_outer")))
    return (
        df.join(hot.select(*keys, F.lit(True).alias("_hot")), keys, "left")
        .withColumn("_hot", F.coalesce("_hot", F.lit(False)))
        .join(borders, keys, "left")
        .withColumn("_at", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
        .withColumn("_outer", F.when(F.col("_g").isNotNull(), outer).otherwise(0))
        .withColumn(
            "_chunk",
            F.when(F.col("_outer") > 0, (F.col("_outer") - 1) * F.col("_m") + inner).otherwise(0).cast("long"),
        )
        .drop("_at", "_outer", "_m", "_g")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    name: str,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order`` (ascending, nulls first).

    Offsets are prefix sums over the totals of a key's chunks, so no window partition
    holds more than one chunk's rows or one key's chunks.  Keys must not be null.
    """
    keys = list(keys)
    upto = (Window.unboundedPreceding, Window.currentRow)
    marked = mark_chunks(df, keys, order, limit)
    if marked is None:
        return df.withColumn(
            name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto))
        )
    marked = marked.withColumn("_v", value)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.filter("_hot").groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_t"))
    offsets = totals.select(*keys, "_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(*upto)
    return (
        marked.withColumn("_in", F.sum("_v").over(inside))
        .join(offsets, [*keys, "_chunk"], "left")
        .withColumn(name, F.coalesce("_off", F.lit(0)) + F.col("_in"))
        .drop("_hot", "_v", "_off", "_in", "_chunk")
    )


def running_max_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    name: str,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Largest ``value`` of the earlier rows of the key in ``order``, null for the first row.

    As ``running_sum``, with the largest values of a key's earlier chunks carried in.  Rows
    that tie in ``order`` share a chunk, where one of them comes first.
    """
    keys = list(keys)
    earlier = (Window.unboundedPreceding, -1)
    marked = mark_chunks(df, keys, order, limit)
    if marked is None:
        return df.withColumn(
            name, F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*earlier))
        )
    marked = marked.withColumn("_v", value)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*earlier)
    totals = marked.filter("_hot").groupBy(*keys, "_chunk").agg(F.max("_v").alias("_t"))
    carried = totals.select(*keys, "_chunk", F.max("_t").over(before).alias("_off"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(*earlier)
    return (
        marked.withColumn("_in", F.max("_v").over(inside))
        .join(carried, [*keys, "_chunk"], "left")
        .withColumn(name, F.greatest("_off", "_in"))
        .drop("_hot", "_v", "_off", "_in", "_chunk")
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    edges: int = 64,
    salts: int = 32,
) -> DataFrame:
    """Exact interpolated quantiles per key without holding a key's values in one task.

    Values are counted first, so copies of one value cost one row.  Approximate
    quantiles (bounded memory, mergeable) give the bucket borders; bucket totals
    turn a rank inside a bucket into a rank inside the key.  Keys must not be null.
    """
    keys = list(keys)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_salt", F.pmod(F.hash("_v"), F.lit(salts)))
    )
    cuts = [i / edges for i in range(1, edges)]
    borders = (
        df.groupBy(*keys)
        .agg(F.percentile_approx(value, cuts, 1000).alias("_b"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    bucketed = counted.join(borders, [*keys, "_salt"]).select(
        *keys,
        "_v",
        "_c",
        F.aggregate("_b", F.lit(0), lambda n, b: n + (b <= F.col("_v")).cast("int")).alias("_k"),
    )
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        bucketed.groupBy(*keys, "_k")
        .agg(F.sum("_c").alias("_t"))
        .select(
            *keys,
            "_k",
            F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"),
            F.sum("_t").over(whole).alias("_n"),
        )
    )
    inside = (
        Window.partitionBy(*keys, "_k")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = (
        bucketed.withColumn("_in", F.sum("_c").over(inside))
        .join(totals, [*keys, "_k"])
        .withColumn("_hi", F.col("_off") + F.col("_in"))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
    )
    aggs = []
    for alias, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(p)
        low, high = F.floor(pos), F.ceil(pos)
        at_low = F.max(F.when((low >= F.col("_lo")) & (low < F.col("_hi")), F.col("_v")))
        at_high = F.max(F.when((high >= F.col("_lo")) & (high < F.col("_hi")), F.col("_v")))
        aggs.append((at_low + (at_high - at_low) * F.max(pos - low)).alias(alias))
    return ranked.groupBy(*keys).agg(*aggs)


def grid_cells(df: DataFrame, cell: int) -> DataFrame:
    """One row per grid cell (``_cx``, ``_cy``) that a box touches."""
    return df.withColumn(
        "_cx", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))
    ).withColumn(
        "_cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell)))
    )


def _gridded(df: DataFrame, on: Sequence[str], prefix: str, cell: int) -> DataFrame:
    return grid_cells(df, cell).select(
        *on, "_cx", "_cy", *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in on]
    )


def _overlapping() -> Column:
    return (
        (F.col("a_x0") < F.col("b_x1"))
        & (F.col("b_x0") < F.col("a_x1"))
        & (F.col("a_y0") < F.col("b_y1"))
        & (F.col("b_y0") < F.col("a_y1"))
    )


def grid_join(
    left: DataFrame, right: DataFrame, cell: int, on: Sequence[str] = ("page",)
) -> DataFrame:
    """Pairs of boxes with a positive overlap; columns get prefixes ``a_`` and ``b_``.

    Only boxes that share a cell meet.  A pair that shares several cells is
    reported in the cell of the overlap's lower corner, so no distinct follows.
    """
    pairs = _gridded(left, on, "a_", cell).join(
        _gridded(right, on, "b_", cell), [*on, "_cx", "_cy"]
    )
    corner_x, corner_y = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    return pairs.filter(
        _overlapping()
        & (F.floor(corner_x / cell) == F.col("_cx"))
        & (F.floor(corner_y / cell) == F.col("_cy"))
    ).drop("_cx", "_cy")


def grid_exists(
    left: DataFrame, right: DataFrame, cell: int, condition: Column, on: Sequence[str] = ("page",)
) -> DataFrame:
    """Distinct rows of ``left`` that overlap some right box for which ``condition`` holds.

    ``condition`` uses the prefixed columns.  A semi join stops at the first hit, so
    no pairs are produced.
    """
    a = _gridded(left, on, "a_", cell)
    b = _gridded(right, on, "b_", cell)
    keys = [*on, "_cx", "_cy"]
    b = b.select(*[F.col(k).alias(f"_b{k}") for k in keys], *[c for c in b.columns if c not in keys])
    match = _overlapping() & condition
    for k in keys:
        match = match & (F.col(k) == F.col(f"_b{k}"))
    return (
        a.join(b, match, "left_semi")
        .select(*[F.col(c) if c in on else F.col(f"a_{c}").alias(c) for c in left.columns])
        .distinct()
    )
