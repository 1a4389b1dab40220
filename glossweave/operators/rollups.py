"""Stored sketches: metrics and distinct counts that are merged without their rows.

An hour's values become one row of sketches, written once.  Days, months and any other
period are merged from stored rows, so a report over a year reads a sketch per key and
hour, not the events.  Quantiles are KLL sketches, whose rank error stays within the same
bound however often they are merged; distinct counts are HyperLogLog sketches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Size of a quantile sketch: ranks are off by less than 0.5 % with a probability of 99 %.
QUANTILE_SIZE = 800
#: log2 of the registers of a distinct sketch: the standard error is 0.8 %.
DISTINCT_BITS = 14


def sketch_metrics(
    events: DataFrame,
    keys: Sequence[str] = ("event_type",),
    value: str = "value",
    distinct: str = "user_id",
    period: str = "hour",
) -> DataFrame:
    """One row per key and period: keys, start, n, cents, max, quantiles, distinct.

    ``cents`` is a sum of hundredths, so that merged means do not depend on the order.  Null
    values count in ``distinct`` only; a null time makes a period of its own.
    """
    cents = F.round(F.col(value) * 100).cast("long")
    return events.groupBy(*keys, F.date_trunc(period, "ts").alias("start")).agg(
        F.count(value).alias("n"),
        F.sum(cents).alias("cents"),
        F.max(value).alias("max"),
        F.kll_sketch_agg_double(F.col(value), QUANTILE_SIZE).alias("quantiles"),
        F.hll_sketch_agg(distinct, DISTINCT_BITS).alias("distinct"),
    )


def merge_metrics(rollup: DataFrame, period: str, keys: Sequence[str] = ("event_type",)) -> DataFrame:
    """Rows of ``sketch_metrics`` merged to a longer period (day, week, month, ...); same columns."""
    return rollup.groupBy(*keys, F.date_trunc(period, "start").alias("start")).agg(
        F.sum("n").alias("n"),
        F.sum("cents").alias("cents"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double(F.col("quantiles"), QUANTILE_SIZE).alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
    )


def report_metrics(
    rollup: DataFrame, probs: Mapping[str, float] | None = None, keys: Sequence[str] = ("event_type",)
) -> DataFrame:
    """Figures of sketch rows: keys, start, n, mean, max, one column per quantile, distinct."""
    probs = probs or {"p50": 0.5, "p95": 0.95}

    def quantile(p: float) -> Column:
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(p)))

    return rollup.select(
        *keys,
        "start",
        "n",
        F.round(F.col("cents") / 100 / F.col("n"), 6).alias("mean"),
        "max",
        *[quantile(p).alias(name) for name, p in probs.items()],
        F.hll_sketch_estimate("distinct").alias("distinct"),
    )


def sketch_distinct(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per key: the rows counted and a sketch of the distinct values.

    For counts over parts that arrive one after another: pages a block occurs on,
    honorifics of a name, values of a setting.
    """
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(F.col(value), DISTINCT_BITS).alias("distinct")
    )


def merge_distinct(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``sketch_distinct`` of several parts merged by key: rows, n_distinct."""
    return parts.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct")
    )
