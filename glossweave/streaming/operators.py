"""Streaming transformations: each takes a stream and returns a stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from glossweave.functions.text import fingerprint
from glossweave.operators.state import EVENT_ROUTES, REJECT, current_state, route_events


def stream_metrics(
    stream: DataFrame,
    width: str,
    slide: str | None = None,
    delay: str = "1 hour",
    quantiles: bool = True,
    accuracy: int = 10_000,
) -> DataFrame:
    """Count, mean, max and approximate p50 and p95 per event type and window; append mode.

    Rows that arrive more than ``delay`` behind the newest event are dropped.  The
    quantile sketches are part of the window state; without them it is smaller.
    """
    cents = F.round(F.col("value") * 100).cast("long")
    aggs = [F.count("value").alias("n"), F.sum(cents).alias("cents"), F.max("value").alias("max")]
    names = ["p50", "p95"] if quantiles else []
    for name, p in zip(names, (0.5, 0.95)):
        aggs.append(F.percentile_approx("value", p, accuracy).alias(name))
    return (
        stream.withWatermark("ts", delay)
        .groupBy("event_type", F.window("ts", width, slide or width))
        .agg(*aggs)
        .select(
            "event_type",
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "n",
            F.round(F.col("cents") / 100 / F.col("n"), 6).alias("mean"),
            "max",
            *names,
        )
    )


def stream_sessions(stream: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Closed sessions (user_id, session_start, session_end, n_events); append mode.

    A row is late only if its own session would have ended by the watermark, so a row can
    still arrive that continues a session already emitted.  It then comes out as a part of
    its own, which ``join_sessions`` puts together with the first.
    """
    return (
        stream.withWatermark("ts", delay)
        .groupBy("user_id", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(
            "user_id",
            F.col("session_window.start").alias("session_start"),
            F.col("session_window.end").alias("session_end"),
            "n_events",
        )
    )


def join_sessions(parts: DataFrame) -> DataFrame:
    """Emitted sessions of ``stream_sessions`` with parts that touch or overlap made one.

    A batch step on the finished output; a part the stream still holds open is not in it.
    """
    by_start = Window.partitionBy("user_id").orderBy("session_start", "session_end")
    before = F.max("session_end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before >= F.col("session_start"), 0).otherwise(1)
    numbered = parts.withColumn("_starts", starts).withColumn(
        "_no", F.sum("_starts").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return (
        numbered.groupBy("user_id", "_no")
        .agg(
            F.min("session_start").alias("session_start"),
            F.max("session_end").alias("session_end"),
            F.sum("n_events").alias("n_events"),
        )
        .drop("_no")
    )


def stream_dedup(stream: DataFrame, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """One row per key inside the watermark; append mode."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def stream_tm_enrich(stream: DataFrame, tm: DataFrame, col: str = "text") -> DataFrame:
    """Exact memory lookup per stream row (stream-static left join); append mode."""
    entries = tm.select("fp", "target")
    return stream.withColumn("fp", fingerprint(F.col(col))).join(entries, "fp", "left")


def stream_current_state(
    stream: DataFrame, key: str = "user_id", state: str = "event_type"
) -> DataFrame:
    """Latest state per key so far; update or complete mode."""
    return current_state(stream, key, state)


def stream_route(
    stream: DataFrame, routes: Mapping[str, str] = EVENT_ROUTES, reject: str = REJECT
) -> DataFrame:
    """Add the target; ``sinks.start_routed`` writes one folder per target."""
    return route_events(stream, routes, reject)


def stream_expire(stream: DataFrame, ttl: str, delay: str = "1 hour", key: str = "user_id") -> DataFrame:
    """An expiry (key, last_use, expired_at, n_uses) when a key stayed idle for ``ttl``; append mode.

    A key's uses with pauses up to the ttl form one session whose end is the last
    use plus the ttl, and the session is emitted once the watermark passes that
    end.  Unlike a timer set per batch this does not depend on how rows are split
    into batches, and uses are merged before the shuffle.
    """
    return (
        stream.withWatermark("ts", delay)
        .groupBy(key, F.session_window("ts", ttl).alias("_w"))
        .agg(F.max("ts").alias("last_use"), F.count(F.lit(1)).alias("n_uses"))
        .select(key, "last_use", F.col("_w.end").alias("expired_at"), "n_uses")
    )
