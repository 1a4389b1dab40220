"""User state and events: history, sessions, settings, sync, routing, metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from glossweave.functions.time import epoch_micros
from glossweave.plans.scale import exact_quantiles

# event type -> target; anything else goes to the reject target.
EVENT_ROUTES = {
    "view": "page_scan",
    "click": "overlay",
    "purchase": "licence",
    "signup": "account",
}
REJECT = "reject"

SETTING_DEFAULTS = {
    "click": "0",
    "error": "0",
    "purchase": "0",
    "signup": "0",
    "theme": "red",
    "view": "0",
}


def recent_history(events: DataFrame, k: int) -> DataFrame:
    """Last ``k`` events per user with their rank (1 = newest).

    The rank filter is planned as a group limit before the shuffle, so a task sends
    at most k rows per user.
    """
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return events.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sessionize(events: DataFrame, gap_seconds: int, key: str = "user_id") -> DataFrame:
    """Sessions (key, session_start, session_end, n_events); a pause longer than the gap starts a new one.

    ``session_end`` is the last event plus the gap, as in ``session_window``.  Events of one key within one
    gap-wide slot always share a session, so slots are aggregated first and only
    slots, at most span / gap of them per key, are put in order.
    """
    micros = epoch_micros(events, "ts")
    gap = gap_seconds * 1_000_000
    slots = events.groupBy(key, F.floor(micros / gap).alias("_slot")).agg(
        F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    w = Window.partitionBy(key).orderBy("_slot")
    pause = F.make_dt_interval(secs=F.lit(gap_seconds))
    fresh = F.coalesce((F.col("_first") > F.lag("_last").over(w) + pause).cast("int"), F.lit(1))
    return (
        slots.withColumn("_new", fresh)
        .withColumn("_s", F.sum("_new").over(w))
        .groupBy(key, "_s")
        .agg(
            F.min("_first").alias("session_start"),
            (F.max("_last") + pause).alias("session_end"),
            F.sum("_n").alias("n_events"),
        )
        .drop("_s")
    )


def resolve_settings(
    defaults: Mapping[str, str], user: DataFrame, device: DataFrame
) -> DataFrame:
    """Effective value per (user_id, device, key): device layer, then user, then default.

    ``user`` is (user_id, key, value) and ``device`` (user_id, device, key, value).
    Every device of the device layer gets every default key plus its own keys and
    its user's keys.
    """
    devices = device.select("user_id", "device").distinct()
    table = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    layers = [
        devices.select("user_id", "device", F.explode(table).alias("key", "value"), F.lit(0).alias("p")),
        devices.join(user.select("user_id", "key", "value"), "user_id").select(
            "user_id", "device", "key", "value", F.lit(1).alias("p")
        ),
        device.select("user_id", "device", "key", "value", F.lit(2).alias("p")),
    ]
    rows = layers[0].unionByName(layers[1]).unionByName(layers[2]).filter(F.col("value").isNotNull())
    names = F.create_map(*[F.lit(x) for kv in enumerate(["default", "user", "device"]) for x in kv])
    return (
        rows.groupBy("user_id", "device", "key")
        .agg(F.max(F.struct("p", "value")).alias("_m"))
        .select(
            "user_id",
            "device",
            "key",
            F.col("_m.value").alias("value"),
            F.element_at(names, F.col("_m.p")).alias("layer"),
        )
    )


def sync_merge(device_rows: DataFrame) -> DataFrame:
    """Last writer wins across devices: (user_id, key, value, device, ts, n_devices, n_values, conflict).

    Ties in ``ts`` go to the higher device, then the higher value.  A key is in
    conflict when the devices' own latest values differ.
    """
    own = device_rows.groupBy("user_id", "key", "device").agg(
        F.max(F.struct("ts", "value")).alias("_m")
    )
    return (
        own.groupBy("user_id", "key")
        .agg(
            F.max(F.struct(F.col("_m.ts"), "device", F.col("_m.value"))).alias("_w"),
            F.count(F.lit(1)).alias("n_devices"),
            F.count_distinct("_m.value").alias("n_values"),
        )
        .select(
            "user_id",
            "key",
            F.col("_w.value").alias("value"),
            F.col("_w.device").alias("device"),
            F.col("_w.ts").alias("ts"),
            "n_devices",
            "n_values",
            (F.col("n_values") > 1).alias("conflict"),
        )
    )


def current_state(events: DataFrame, key: str = "user_id", state: str = "event_type") -> DataFrame:
    """Latest state per key by (ts, event_id)."""
    return (
        events.groupBy(key)
        .agg(F.max(F.struct("ts", "event_id", state)).alias("_m"))
        .select(key, F.col(f"_m.{state}").alias("state"), F.col("_m.ts").alias("since"))
    )


def route_events(
    events: DataFrame, routes: Mapping[str, str] = EVENT_ROUTES, reject: str = REJECT
) -> DataFrame:
    """Add ``target`` from the route table, which is a literal map; unknown types are rejected."""
    table = F.create_map(*[F.lit(x) for kv in routes.items() for x in kv])
    return events.withColumn(
        "target", F.coalesce(F.try_element_at(table, F.col("event_type")), F.lit(reject))
    )


def performance_metrics(
    events: DataFrame, width: str, exact: bool = False, accuracy: int = 10_000
) -> DataFrame:
    """Count, mean, p50, p95 and max of ``value`` per event type and tumbling window.

    The default uses mergeable approximate quantiles; ``exact`` ranks the values.
    """
    keyed = events.select(
        "event_type", F.window("ts", width)["start"].alias("window_start"), "value"
    )
    keys = ["event_type", "window_start"]
    basic = [
        F.count("value").alias("n"),
        F.round(F.sum(F.round(F.col("value") * 100).cast("long")) / 100 / F.count("value"), 6).alias(
            "mean"
        ),
        F.max("value").alias("max"),
    ]
    if not exact:
        return keyed.groupBy(*keys).agg(
            *basic,
            F.percentile_approx("value", 0.5, accuracy).alias("p50"),
            F.percentile_approx("value", 0.95, accuracy).alias("p95"),
        )
    ranks = exact_quantiles(keyed, keys, "value", {"p50": 0.5, "p95": 0.95})
    return (
        keyed.groupBy(*keys)
        .agg(*basic)
        .join(ranks, keys, "left")
        .select(*keys, "n", "mean", "max", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))
    )
