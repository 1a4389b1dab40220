"""Layout tables: range joins on a grid, suppression, merging, ranking.

Boxes are (id, page, x0, y0, x1, y1, score).  Boxes that touch only at an edge do
not overlap.  Where the result allows it, equal boxes of a page are collapsed
before they are paired, so a page that holds a large share of all rows costs no
more pairs than its distinct boxes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from glossweave.functions.boxes import area, iou, overlap_area
from glossweave.plans.levels import level_join
from glossweave.plans.scale import HOT_ROWS, grid_cells, grid_exists, grid_join, hot_keys, running_max_before, running_sum
from glossweave.session import stored

BOX = ["x0", "y0", "x1", "y1"]
CELL = 128
DENSE = 2_000
#: Boxes that one task decides together in greedy suppression.
FOLD = 500
#: Rounds of cuts in one pass over the groups that fit a task.
ROUNDS = 3


def _met(left: DataFrame, right: DataFrame, cell: int | None) -> DataFrame:
    """Overlapping pairs on a grid of one cell size, or on one with levels for boxes of all sizes."""
    return level_join(left, right) if cell is None else grid_join(left, right, cell)


def overlap_pairs(regions: DataFrame, min_iou: float = 0.0, cell: int | None = None) -> DataFrame:
    """Overlapping pairs of one page, a_id < b_id, with areas, intersection and IoU.

    Every overlapping pair is an output row, so copies cannot be collapsed here;
    the grid keeps boxes that are far apart from meeting at all.  Without ``cell`` it has a
    level for each size of boxes, and crowded cells are spread over tasks.
    """
    boxes = regions.select("page", "id", *BOX)
    pairs = _met(boxes, boxes, cell).filter("a_id < b_id")
    return pairs.select(
        "page",
        "a_id",
        "b_id",
        area("a_").alias("a_area"),
        area("b_").alias("b_area"),
        overlap_area().alias("shared"),
        iou().alias("iou"),
    ).filter(F.col("iou") >= min_iou)


def _leaders(regions: DataFrame) -> DataFrame:
    """Distinct boxes of each page with the rank of their strongest member.

    Rank orders by score, then by lower id; it is a struct so that ``max`` and
    ``>`` follow it.
    """
    return regions.groupBy("page", *BOX).agg(F.max(F.struct("score", -F.col("id"))).alias("rank"))


def _beats(min_iou: float) -> Column:
    """b outranks a and their IoU reaches the threshold."""
    return (F.col("b_rank") > F.col("a_rank")) & (iou() >= min_iou)


def suppress_overlaps(
    regions: DataFrame,
    min_iou: float = 0.3,
    mode: str = "local",
    cell: int = CELL,
) -> DataFrame:
    """Drop boxes that a stronger box of the page overlaps by at least ``min_iou``.

    ``local`` drops a box if any stronger neighbour exists.  ``greedy`` drops it
    only if a stronger neighbour is itself kept.  ``min_iou`` must be above 0.
    """
    leaders = _leaders(regions)
    member = F.struct("score", -F.col("id"))
    if mode == "local":
        beaten = grid_exists(leaders, leaders, cell, _beats(min_iou))
        kept = leaders.join(beaten, ["page", *BOX], "left_anti")
    elif mode == "greedy":
        kept = _greedy(leaders, min_iou, cell)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    # Copies of a kept box overlap it fully, so only its strongest member stays.
    best = kept.select("page", *BOX, F.col("rank").alias("_rank"))
    return (
        regions.join(best, ["page", *BOX])
        .filter(member == F.col("_rank"))
        .select(*regions.columns)
    )


def _greedy(leaders: DataFrame, min_iou: float, cell: int) -> DataFrame:
    """Settle small groups at once, and large ones by rounds until they fall apart.

    A page, or a set of boxes connected by overlaps, of at most ``FOLD`` boxes is decided
    in one fold from the strongest box down.  What is larger loses in each round the
    boxes without a stronger neighbour and those they drop, and is cut into connected
    sets again.  Every round decides boxes, so the rounds end by themselves.
    """
    key = ["page", *BOX]
    rest = stored(leaders.withColumn("group", F.lit(0).cast("long")), "undecided")
    kept: list[DataFrame] = []
    while True:
        sizes = stored(rest.groupBy("page", "group").count(), "sizes")
        small, large = sizes.filter(F.col("count") <= FOLD), sizes.filter(F.col("count") > FOLD)
        kept.append(stored(_fold(rest.join(small, ["page", "group"], "left_semi"), min_iou), "kept"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, kept)
        open_boxes = stored(rest.join(large, ["page", "group"], "left_semi").drop("group"), "undecided")
        blocked = stored(grid_exists(open_boxes, open_boxes, cell, _beats(min_iou)), "blocked")
        winners = stored(open_boxes.join(blocked, key, "left_anti"), "kept")
        kept.append(winners)
        losers = grid_exists(blocked, winners, cell, iou() >= min_iou)
        left = stored(
            blocked.join(losers, key, "left_anti").withColumn("id", -F.col("rank.col2")), "undecided"
        )
        touching = grid_join(left, left, cell).filter((F.col("a_id") < F.col("b_id")) & (iou() >= min_iou))
        parts = connected_components(touching.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
        rest = stored(
            left.join(parts, left["id"] == parts["node"], "left").select(
                *key, "rank", F.coalesce("component", "id").alias("group")
            ),
            "undecided",
        )


def _fold(boxes: DataFrame, min_iou: float) -> DataFrame:
    """Per group, from the strongest box down: keep a box if it overlaps none kept so far."""
    box = F.struct("rank", *BOX)

    def shared(a: Column, b: Column) -> Column:
        wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
        high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
        return F.when((wide > 0) & (high > 0), wide * high).otherwise(0)

    def size(a: Column) -> Column:
        return (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])

    def clash(a: Column, b: Column) -> Column:
        both = shared(a, b)
        return (both > 0) & (both / (size(a) + size(b) - both) >= min_iou)

    grouped = boxes.groupBy("page", "group").agg(F.sort_array(F.collect_list(box), asc=False).alias("_all"))
    none = F.slice("_all", 1, 0)
    chosen = F.aggregate(
        "_all", none, lambda kept, b: F.when(F.exists(kept, lambda k: clash(k, b)), kept).otherwise(F.concat(kept, F.array(b)))
    )
    return grouped.select("page", F.explode(chosen).alias("_b")).select(
        "page", *[F.col(f"_b.{c}").alias(c) for c in BOX], F.col("_b.rank").alias("rank")
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of each node of an undirected edge table (a, b), as (node, component).

    Alternates "large star" and "small star" rewiring (Kiveris et al., SoCC 2014),
    which needs a logarithmic number of rounds even for long chains; each round is
    a minimum per node and a join, and is written to the shared folder.
    """
    pairs = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u != v")
        .distinct()
    )
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        pairs = stored(small.filter("u != v").distinct())
        state = pairs.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            break
        seen = state
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = leaves.select(F.col("component").alias("node"), "component").distinct()
    return leaves.unionByName(roots)


def merge_regions(regions: DataFrame, cell: int = CELL, dense: int = DENSE) -> DataFrame:
    """Union overlapping boxes into text blocks.

    Result: (page, block_id = lowest region id, n_regions, x0, y0, x1, y1).  If some
    cell holds more than ``dense`` distinct boxes, boxes around a common lattice
    point, which all overlap, are united through that point first; pairs are then
    formed only between boxes that are still apart.
    """
    distinct = stored(
        regions.groupBy("page", *BOX).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")),
        "boxes",
    )
    crowded = (
        grid_cells(distinct, cell).groupBy("page", "_cx", "_cy").count().filter(F.col("count") > dense)
    )
    if crowded.isEmpty():
        owned = distinct.withColumn("block_id", F.col("id"))
    else:
        owned = stored(_relabel(distinct, "id", _lattice_edges(distinct, cell // 4)), "boxes")
    parts = owned.select("page", "block_id", *BOX)
    touching = grid_join(parts, parts, cell).filter("a_block_id < b_block_id")
    edges = touching.select(F.col("a_block_id").alias("a"), F.col("b_block_id").alias("b"))
    return (
        _relabel(owned, "block_id", edges)
        .groupBy("page", "block_id")
        .agg(
            F.sum("n").alias("n_regions"),
            F.min("x0").alias("x0"),
            F.min("y0").alias("y0"),
            F.max("x1").alias("x1"),
            F.max("y1").alias("y1"),
        )
    )


def _relabel(boxes: DataFrame, label: str, edges: DataFrame) -> DataFrame:
    """Replace ``block_id`` by the component of ``label``, or by the label if it has no edge."""
    parts = connected_components(edges).withColumnRenamed("node", "_label")
    return (
        boxes.withColumn("_label", F.col(label))
        .join(parts, "_label", "left")
        .withColumn("block_id", F.coalesce("component", "_label"))
        .drop("_label", "component")
    )


def _lattice_edges(boxes: DataFrame, step: int) -> DataFrame:
    """Each box tied to the lowest id among the boxes strictly around a lattice point."""

    def inside(low: str, high: str) -> Column:
        first, last = F.floor(F.col(low) / step) + 1, F.ceil(F.col(high) / step) - 1
        return F.when(first <= last, F.sequence(first, last))

    points = boxes.select("page", "id", F.explode(inside("x0", "x1")).alias("px"), "y0", "y1").select(
        "page", "id", "px", F.explode(inside("y0", "y1")).alias("py")
    )
    lowest = points.groupBy("page", "px", "py").agg(F.min("id").alias("b"))
    return points.join(lowest, ["page", "px", "py"]).select(F.col("id").alias("a"), "b")


def assign_to_panels(regions: DataFrame, panels: DataFrame, cell: int | None = None) -> DataFrame:
    """Best panel per region by shared area (lower panel number on ties), null if none.

    Regions and panels of any size meet on a grid with levels; ``cell`` fixes one cell size.
    The distinct boxes are written to the shared folder, since the grid looks them up first.
    """
    boxes = stored(regions.select("page", *BOX).distinct(), "boxes")
    best = (
        _met(boxes, panels.select("page", "panel_no", *BOX), cell)
        .groupBy("page", *[F.col(f"a_{c}").alias(c) for c in BOX])
        .agg(F.max(F.struct(overlap_area().alias("s"), (-F.col("b_panel_no")).alias("p"))).alias("_m"))
        .select("page", *BOX, (-F.col("_m.p")).alias("panel_no"), F.col("_m.s").alias("shared"))
    )
    return regions.join(best, ["page", *BOX], "left").select(
        "page", "id", *BOX, "panel_no", F.coalesce("shared", F.lit(0)).alias("shared")
    )


def reading_order(
    regions: DataFrame,
    direction: str = "rtl",
    band: int = 60,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Order of regions inside (page, panel).

    ``rtl`` and ``ltr`` read row bands from the top, each in the direction; ``vertical``
    reads column bands from the right, each downwards.  Regions without a panel (null
    ``panel_no``) form a group of their own, numbered -1.
    """
    if direction == "vertical":
        order = [-F.floor(F.col("x1") / band), F.col("y0"), -F.col("x1"), F.col("id")]
    elif direction in ("rtl", "ltr"):
        across = -F.col("x1") if direction == "rtl" else F.col("x0")
        order = [F.floor(F.col("y0") / band), across, F.col("y0"), F.col("id")]
    else:
        raise ValueError(f"unknown direction {direction!r}")
    placed = regions.withColumn("panel_no", F.coalesce("panel_no", F.lit(-1)))
    return running_sum(
        placed,
        ["page", "panel_no"],
        order,
        F.lit(1),
        "ord",
        limit,
    ).select("page", "panel_no", "id", "ord")


def _gap(axis: str, reach: Column) -> Column:
    """1 where a box begins at or behind the reach of those before it, else 0."""
    return F.coalesce((F.col(f"{axis}0") >= reach).cast("int"), F.lit(0))


def _cut(df: DataFrame, axis: str, backwards: bool, limit: int) -> DataFrame:
    """Append to ``path`` the part a box falls into when its group is cut at gaps along an axis.

    A gap is a stretch of the axis that no box of the group covers.  ``_parts`` counts the
    gaps found so far in the group, up to the box.
    """
    high = F.col(f"{axis}1")
    keys, order = ["page", "panel_no", "path"], [F.col(f"{axis}0"), high, F.col("id")]
    reach = stored(running_max_before(df, keys, order, high, "_reach", limit), "cuts")
    cut = running_sum(reach.withColumn("_gap", _gap(axis, F.col("_reach"))), keys, order, F.col("_gap"), "_part", limit)
    part = F.col("_part").cast("long")
    return cut.select(
        "page", "panel_no", "id", *BOX, F.concat("path", F.array(-part if backwards else part)).alias("path"),
        F.greatest("_parts", part).alias("_parts"),
    )


def _cut_spread(boxes: DataFrame, axes: list, order: list, limit: int) -> DataFrame:
    """(page, panel_no, id, ord) of groups too large for a task: a level of nesting is a round, windowed in chunks."""
    live = boxes.withColumns({"path": F.array().cast("array<bigint>"), "_parts": F.lit(0).cast("long")})
    settled: list[DataFrame] = []
    while True:
        for axis, backwards in axes:
            live = stored(_cut(live, axis, backwards, limit), "cuts")
        # a part goes on if its group, known by the path before this round, was cut
        group = ["page", "panel_no", F.slice("path", F.lit(1), F.size("path") - 2).alias("_from")]
        cut = live.groupBy(*group).agg(F.max("_parts").alias("_most")).filter("_most > 0")
        keyed = live.withColumn("_from", F.slice("path", F.lit(1), F.size("path") - 2))
        keys = ["page", "panel_no", "_from"]
        settled.append(keyed.join(cut, keys, "left_anti").drop("_from"))
        more = stored(keyed.join(cut, keys, "left_semi").drop("_from").withColumn("_parts", F.lit(0).cast("long")), "cuts")
        if more.isEmpty():
            break
        live = more
    rows = stored(reduce(DataFrame.unionByName, settled), "cuts")
    return running_sum(rows, ["page", "panel_no"], [F.col("path"), *order], F.lit(1), "ord", limit).select(
        "page", "panel_no", "id", "ord"
    )


def _cut_together(boxes: DataFrame, axes: list, order: list) -> DataFrame:
    """(page, panel_no, id, ord) of groups that fit a task, ``ROUNDS`` levels of nesting in a pass.

    A pass shuffles its boxes once: all its windows keep a group where it is.  Groups that
    its last round still cut go on in another pass, from the parts they have by then.
    """
    group, settled = ["page", "panel_no"], []
    live = boxes.withColumn("_part", F.lit(0).cast("long"))
    while True:
        live, path = live.repartition(*group), ["_part"]
        for no in range(ROUNDS):
            for axis, backwards in axes:
                along = Window.partitionBy(*group, *path).orderBy(f"{axis}0", f"{axis}1", "id")
                reach = F.max(f"{axis}1").over(along.rowsBetween(Window.unboundedPreceding, -1))
                live = live.withColumn("_gap", _gap(axis, reach))
                part = F.sum("_gap").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                path.append(f"_{axis}{no}")
                live = live.withColumn(path[-1], -part if backwards else part).drop("_gap")
        read = Window.partitionBy(*group).orderBy(*path, *order)
        last = F.greatest(*[F.abs(step) for step in path[-2:]])
        live = live.withColumn("ord", F.row_number().over(read).cast("long")).withColumns({
            "_part": F.min("ord").over(Window.partitionBy(*group, *path)),
            "_open": F.max(last).over(Window.partitionBy(*group)) > 0,
        })
        kept = [F.when(F.col("_open"), F.col(c)).alias(c) for c in (*BOX, "_part")]
        live = stored(live.select(*group, "id", "ord", "_open", *kept), "cuts")
        settled.append(live.filter("NOT _open").select(*group, "id", "ord"))
        live = live.filter("_open").select(*group, "id", *BOX, "_part")
        if live.isEmpty():
            return reduce(DataFrame.unionByName, settled)


def reading_order_cuts(regions: DataFrame, direction: str = "rtl", limit: int = HOT_ROWS) -> DataFrame:
    """Order of regions inside (page, panel) by recursive cuts: page, panel_no, id, ord.

    A group of boxes is cut at every horizontal gap, the parts at every vertical gap, and
    so on until no part has a gap left.  ``rtl`` and ``ltr`` cut into rows first and read the
    columns of a row in the direction; ``vertical`` cuts into columns first, read from the
    right.  Boxes of one part, which overlap in both projections, are read by their upper
    edge, then across.  No row height is assumed, so staggered panels keep together.
    The regions are written to the shared folder once.  Groups of at most ``limit`` boxes are
    cut in place, some levels of nesting for each shuffle; a larger one is cut in rounds over
    the parts that were cut in the last one, windowed in chunks.
    Regions without a panel form a group numbered -1; a null edge comes first and cuts nothing.
    """
    if direction not in ("rtl", "ltr", "vertical"):
        raise ValueError(f"unknown direction {direction!r}")
    across = F.col("x0") if direction == "ltr" else -F.col("x1")
    axes = [("x", True), ("y", False)] if direction == "vertical" else [("y", False), ("x", direction == "rtl")]
    order = [across, F.col("y0"), F.col("id")] if direction == "vertical" else [F.col("y0"), across, F.col("id")]
    group = ["page", "panel_no"]
    boxes = stored(
        regions.select("page", F.coalesce("panel_no", F.lit(-1)).alias("panel_no"), "id", *BOX), "boxes"
    )
    hot = hot_keys(boxes, group, limit)
    if hot is None:
        return _cut_together(boxes, axes, order)
    fit = boxes.join(hot, group, "left_anti")
    large = boxes.join(hot.select(*group), group, "left_semi")
    return _cut_together(fit, axes, order).unionByName(_cut_spread(large, axes, order, limit))


def _covered(boxes: DataFrame, protected: DataFrame, cell: int | None) -> DataFrame:
    """Protected area under each distinct box, and how many protected boxes it meets."""
    shapes = stored(boxes.select("page", *BOX).distinct(), "boxes")
    art = protected.groupBy("page", *BOX).agg(F.count(F.lit(1)).alias("n"))
    return (
        _met(shapes, art, cell)
        .groupBy("page", *[F.col(f"a_{c}").alias(c) for c in BOX])
        .agg(
            F.sum(overlap_area() * F.col("b_n")).alias("covered"),
            F.sum("b_n").alias("n_protected"),
        )
    )


def collision_audit(placements: DataFrame, protected: DataFrame, cell: int | None = None) -> DataFrame:
    """Each placement (id, cand, page, box) with the protected area it covers."""
    hit = _covered(placements, protected, cell)
    return placements.join(hit, ["page", *BOX], "left").select(
        "page",
        "id",
        "cand",
        F.coalesce("covered", F.lit(0)).alias("covered"),
        F.coalesce("n_protected", F.lit(0)).alias("n_protected"),
    )


def choose_placement(candidates: DataFrame, protected: DataFrame, cell: int | None = None) -> DataFrame:
    """Per bubble the candidate that covers least, the lower candidate number on ties."""
    audited = collision_audit(candidates, protected, cell)
    return (
        audited.groupBy("page", "id")
        .agg(F.min(F.struct("covered", "cand")).alias("_m"))
        .select("page", "id", F.col("_m.cand").alias("cand"), F.col("_m.covered").alias("covered"))
    )
