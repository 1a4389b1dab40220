"""Mix sources to target weights by pivotal dependent rounding.

Each source gets a share of the words by weight, at most ``most`` times what it has.
The ratio of target to size says how often a document is taken: its whole part always,
its fraction with that probability.  The fractions are drawn dependently, after the
pivotal method (Deville and Tille 1998): two documents meet, and words move from one's
fraction to the other's, in a direction drawn at random, until one fraction is 0 or 1;
the other goes on with what is left.  Every document keeps its expected number of
copies, and the words taken stay what they were, so a source misses its target by at
most the one document that remains at the end.  Documents meet in falling order of
size, which makes that one a small one.

Documents meet in chunks of about 64 of one source; each chunk passes one document on,
and these meet in the next level of a reduction tree.  A source that holds a third of
all rows only has more chunks.  Everything is DataFrame work on rows of ids and sizes;
texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glossweave.llm.common import fresh, type_of, union_all, word_count
from glossweave.session import stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
CHUNK_BITS = 6
SEED = 20
#: Equal rows that one task makes from their count.
REPEATS = 10_000


def ranked_sources(sized: DataFrame) -> DataFrame:
    """(source, source_size, number): numbers count from 0 in code point order, null last.

    Sources are dealt into ranges first, so no task sees them all.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = stored(
        totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "sources",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return (
        dealt.withColumn("at", F.row_number().over(inside) - 1)
        .join(starts, "part")
        .select("source", "source_size", (F.col("start") + F.col("at")).alias("number"))
    )


def source_targets(
    sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, source_size, target).

    A target is level * weight, at most ``most`` times the source's size.  Each pass
    reshares what the capped sources leave; the level only rises, and the passes end
    when no further source reaches its cap.
    """
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    sources = stored(ranked_sources(sized).withColumn("weight", pick), "ranked")
    cap = F.col("source_size") * F.lit(most)
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") >= cap
        n, used, open_weight = sources.agg(
            F.count(F.when(full, 1)),
            F.sum(F.when(full, cap).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
        ).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (total - used) / open_weight
    return sources.select(
        "source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).cast("double").alias("target")
    )


def _chance(level: int, *of: Column) -> Column:
    """A number in [0, 1) that depends only on the seed, the level and what is drawn for."""
    return F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), *of), F.lit(1 << 40)) / float(1 << 40)


def _numbered(sized: DataFrame) -> DataFrame:
    """``sized`` with a ``number`` that tells equal rows apart, from 0.

    Equal rows are counted and made again from their count, in blocks that are dealt to
    tasks, so a row that makes up a third of the table is spread, and reruns agree.
    """
    rows = stored(sized.groupBy("doc_id", "size", "source").agg(F.count(F.lit(1)).alias("n")), "counted")
    once = rows.filter("n = 1").select("doc_id", "size", "source", F.lit(0).cast("long").alias("number"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS)))
    blocks = rows.filter("n > 1").withColumn("block", block).repartition("doc_id", "size", "source", "block")
    first = F.col("block") * REPEATS
    last = F.least(first + REPEATS, F.col("n")) - 1
    again = blocks.select("doc_id", "size", "source", F.explode(F.sequence(first, last)).alias("number"))
    return once.unionByName(again)


def _meet(units: Column, unit_type: str, level: int) -> Column:
    """Let the units of one chunk meet in falling order; the settled ones, and one carried on."""
    names = ["size", "doc_id", "number", "source_size", "target", "copies", "p"]

    def with_p(u: Column, p: Column, plus: Column = F.lit(0)) -> Column:
        return F.struct(
            *[u[n].alias(n) for n in names[:5]],
            (u["copies"] + plus).cast("int").alias("copies"),
            p.cast("double").alias("p"),
        )

    def step(acc: Column, x: Column) -> Column:
        a = acc["carry"]
        up_a, down_a = (1 - a["p"]) * a["size"], a["p"] * a["size"]
        up_x, down_x = (1 - x["p"]) * x["size"], x["p"] * x["size"]
        to_a, to_x = F.least(up_a, down_x), F.least(down_a, up_x)
        # drawn so that both fractions keep their expected value
        drawn = _chance(level, a["doc_id"], a["number"], x["doc_id"], x["number"])
        rises = drawn < to_x / (to_a + to_x)
        a_settles = F.when(rises, up_a <= down_x).otherwise(down_a <= up_x)
        moved = F.when(rises, to_a).otherwise(-to_x)
        settled = F.when(a_settles, with_p(a, F.lit(0.0), F.when(rises, 1).otherwise(0))).otherwise(
            with_p(x, F.lit(0.0), F.when(rises, 0).otherwise(1))
        )
        left = F.when(a_settles, x["p"] - moved / x["size"]).otherwise(a["p"] + moved / a["size"])
        left = F.greatest(F.lit(0.0), F.least(F.lit(1.0), left))
        carried = F.when(a_settles, with_p(x, left)).otherwise(with_p(a, left))
        return F.when(
            a.isNull(), F.struct(acc["settled"].alias("settled"), with_p(x, x["p"]).alias("carry"))
        ).otherwise(
            F.struct(F.concat(acc["settled"], F.array(settled)).alias("settled"), carried.alias("carry"))
        )

    start = F.struct(
        F.array().cast(f"array<{unit_type}>").alias("settled"), F.lit(None).cast(unit_type).alias("carry")
    )
    return F.aggregate(F.reverse(F.array_sort(units)), start, step)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies.

    size counts words, target is the source's, taken is copies * size.  A null text or
    one without words has size 0 and takes nothing; a very long one counts whole.  Rows
    without a source form one of their own.  Repeated rows, and rows without an id, are
    documents of their own and draw by their number among equal rows.  Draws depend on
    ids, sizes and these numbers only, so reruns agree.  An empty table gives no rows;
    other columns are ignored.
    """
    sized = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            word_count(F.col(text_col).cast("string")).alias("size"),
            F.col(source_col).alias("source"),
        ),
        "sized",
    )
    targets = stored(source_targets(sized, weights, share, most), "targets").withColumnRenamed("source", "_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = _numbered(sized).join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(
        "source",
        F.xxhash64(F.lit(SEED), "doc_id", "size", "number").alias("draw"),
        F.struct(
            "size",
            "doc_id",
            "number",
            "source_size",
            "target",
            F.floor(ratio).cast("int").alias("copies"),
            F.when(F.col("size") > 0, ratio - F.floor(ratio)).otherwise(0.0).alias("p"),
        ).alias("unit"),
    )
    unit_type = (
        f"struct<size:bigint,doc_id:{type_of(sized, 'doc_id')},number:bigint,source_size:bigint,"
        "target:double,copies:int,p:double>"
    )
    units = stored(units, "units")
    whole = units.filter("unit.p = 0").select("unit.*")
    open_units = units.filter("unit.p > 0")
    largest = open_units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, (largest - 1).bit_length() - CHUNK_BITS)
    done, level = [whole], 0
    while True:
        chunk = F.shiftrightunsigned("draw", 64 - bits) if bits else F.lit(0)
        met = stored(
            open_units.groupBy("source", chunk.alias("chunk"))
            .agg(F.collect_list("unit").alias("units"), F.min("draw").alias("draw"))
            .select("source", "draw", _meet(F.col("units"), unit_type, level).alias("met")),
            "mixed",
        )
        done.append(met.select(F.inline("met.settled")))
        open_units = met.select("source", "draw", F.col("met.carry").alias("unit"))
        if not bits:
            break
        level, bits = level + 1, max(0, bits - CHUNK_BITS)
    last = open_units.select("unit.*")
    take = _chance(level + 1, F.col("doc_id"), F.col("size"), F.col("number")) < F.col("p")
    done.append(last.withColumn("copies", F.col("copies") + F.when(take, 1).otherwise(0)))
    return union_all(done).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        F.col("copies").cast("long").alias("copies"),
    )


def repeated(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each row as often as the plan of ``mix`` takes it; ids must be distinct.

    A single row without an id counts as one; a row that is taken no time goes.
    """
    key, n, copy = (fresh(docs, name) for name in ("key", "times", "copy"))
    times = plan.filter("copies > 0").select(F.col("doc_id").alias(key), F.col("copies").alias(n))
    return (
        docs.join(times, F.col(id_col).eqNullSafe(F.col(key)))
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
        .drop(key, n, copy)
    )
