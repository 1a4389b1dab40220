"""Streams with keyed state of their own, and enrichment from a memory that changes.

The operators that call ``transformWithState`` need the RocksDB state store, which keeps
state on disk and not in the heap; start them inside ``rocksdb_state``.  Times in state are
microseconds, so no time zone of a Python worker enters a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glossweave.functions.text import fingerprint

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Keys of ``stream_expire_timers`` share so many rows of state.
EXPIRY_BUCKETS = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _packed(rows: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(parts, columns: list[str]) -> pd.DataFrame:
    frames = [pa.ipc.open_stream(p[0]).read_all().to_pandas() for p in parts]
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=columns)


class _Expiry(StatefulProcessor):
    """The open runs of uses of a bucket's keys, packed in one value, and one timer at the end of the run that ends first."""

    RUNS = ["key", "first", "last", "n"]

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "rows binary, timer bigint")

    def _over_at(self, last):
        """The first millisecond at which a run with this last use is over."""
        return -(-(last + self.ttl) // 1000)

    def _merged(self, runs: pd.DataFrame) -> pd.DataFrame:
        """Runs of one key that lie no more than the ttl apart are one."""
        runs = runs.sort_values(["key", "first"], ignore_index=True)
        key, first = runs["key"].to_numpy(), runs["first"].to_numpy("int64")
        reach = runs.groupby("key", sort=False)["last"].cummax().to_numpy("int64")
        new = np.append(True, (key[1:] != key[:-1]) | (first[1:] - reach[:-1] > self.ttl))
        starts = np.flatnonzero(new)
        last, n = (runs[c].to_numpy("int64") for c in ("last", "n"))
        return pd.DataFrame(
            {"key": key[starts], "first": first[starts], "last": np.maximum.reduceat(last, starts), "n": np.add.reduceat(n, starts)}
        )

    def _hold(self, runs: pd.DataFrame, timer: int | None) -> None:
        wanted = int(self._over_at(int(runs["last"].min())))
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
        self.runs.update((_packed(runs), wanted))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.runs.get()
        runs, timer = (None, None) if held is None else (_unpacked([held], self.RUNS), held[1])
        for part in rows:
            uses = pd.DataFrame({"key": part["key"], "first": part["at"], "last": part["at"], "n": 1})
            runs = self._merged(uses if runs is None else pd.concat([runs, uses], ignore_index=True))
        if runs is not None:
            self._hold(runs, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs = _unpacked([self.runs.get()], self.RUNS)
        over = self._over_at(runs["last"]) <= timerValues.getCurrentWatermarkInMs()
        if over.all():
            self.runs.clear()
        else:
            self._hold(runs[~over], None)
        yield runs[over].rename(columns={"last": "last_use", "n": "n_uses"})[["key", "last_use", "n_uses"]]

    def close(self) -> None:
        pass


def stream_expire_timers(
    stream: DataFrame, ttl: int, delay: str = "1 hour", key: str = "user_id", buckets: int = EXPIRY_BUCKETS
) -> DataFrame:
    """An expiry (key, last_use, expired_at, n_uses) once a key stayed idle for ``ttl`` seconds; append mode.

    Keys fall into ``buckets`` by hash, and a bucket holds the open runs of uses of its keys.
    An event-time timer fires once the watermark passes the last use of a bucket's first
    run to end by the ttl; all its runs that are over come out then.  A use that arrives out of order inside the
    delay joins the runs it is near to, also two runs into one, so the expiries do not
    depend on how rows are split into batches.  Rows behind the watermark are dropped; a
    null time or key forms no use.  State is one packed row for each bucket, so calls to the
    store grow with buckets and not with keys; a checkpoint keeps its number of buckets.
    """
    uses = stream.withWatermark("ts", delay).filter(F.col(key).isNotNull() & F.col("ts").isNotNull())
    kind = stream.schema[key].dataType.simpleString()
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets))
    fired = (
        uses.select(bucket.alias("bucket"), F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("at"))
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=_Expiry(ttl * 1_000_000),
            outputStructType=f"key {kind}, last_use long, n_uses long",
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return fired.select(
        F.col("key").alias(key),
        F.timestamp_micros("last_use").alias("last_use"),
        F.timestamp_micros(F.col("last_use") + ttl * 1_000_000).alias("expired_at"),
        "n_uses",
    )


class _Latest(StatefulProcessor):
    """The newest state of a key by time, then event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "state string, at long, event_id long")

    def _newer(self, rows) -> tuple | None:
        held = self.latest.get() if self.latest.exists() else None
        best = None if held is None else tuple(held)
        for r in rows:
            found = (r["state"], r["at"], r["event_id"])
            if best is None or found[1:] > best[1:]:
                best = found
        if best is not None:
            self.latest.update(best)
        return best

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._newer([initialState])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = self._newer(rows)
        if best is not None:
            yield Row(key=key[0], state=best[0], at=best[1])

    def close(self) -> None:
        pass


def _state_rows(df: DataFrame, key: str, state: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(
        F.col(key).alias("key"), F.col(state).alias("state"), F.unix_micros("ts").alias("at"), "event_id"
    )


def state_snapshot(events: DataFrame, key: str = "user_id", state: str = "event_type") -> DataFrame:
    """The state table a stream can start from: (key, state, at, event_id), one row per key."""
    rows = _state_rows(events.withColumn("ts", F.col("ts").cast("timestamp")), key, state)
    newest = F.max(F.struct("at", "event_id", "state")).alias("m")
    return rows.groupBy("key").agg(newest).select("key", "m.state", "m.at", "m.event_id")


def stream_keyed_state(
    stream: DataFrame, snapshot: DataFrame | None = None, key: str = "user_id", state: str = "event_type"
) -> DataFrame:
    """Latest state (key, state, since) of every key a batch touches; update mode.

    The state is a value per key in the state store.  ``snapshot`` (see
    ``state_snapshot``) is loaded in the first batch of a new checkpoint, so a stream can
    be started again from a table instead of from all events.  Events may come in any
    order: the newest by (ts, event_id) stands.
    """
    kind = stream.schema[key].dataType.simpleString()
    start = None if snapshot is None else snapshot.select("key", "state", "at", "event_id").groupBy("key")
    found = (
        _state_rows(stream, key, state)
        .groupBy("key")
        .transformWithState(
            statefulProcessor=_Latest(),
            outputStructType=f"key {kind}, state string, at long",
            outputMode="Update",
            timeMode="None",
            initialState=start,
        )
    )
    return found.select(F.col("key").alias(key), "state", F.timestamp_micros("at").alias("since"))


def stored_state(spark: SparkSession, checkpoint: str, key: str = "user_id") -> DataFrame:
    """The state table (key, state, since) of a query of ``stream_keyed_state``, read from its checkpoint.

    The state data source reads the last committed batch of the store itself, so what the
    stream would go on from can be compared with a batch recomputation.
    """
    rows = spark.read.format("statestore").option("stateVarName", "latest").load(checkpoint)
    return rows.select(
        F.col("key.key").alias(key), F.col("value.state").alias("state"),
        F.timestamp_micros("value.at").alias("since"),
    )


class _AsOf(StatefulProcessor):
    """A fingerprint's open events and entries, each batch of them in one packed row, and one timer."""

    ASKED, LEARNT = ["id", "at", "low", "due"], ["target", "at", "due"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getListState("asked", "rows binary")
        self.learnt = handle.getListState("learnt", "rows binary")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, due: int) -> None:
        """Keep one timer, at the first millisecond something is due."""
        at = -(-due // 1000)
        held = self.timer.get()[0] if self.timer.exists() else None
        if held is None or at < held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due = []
        for part in rows:
            for state, mine, columns in (
                (self.asked, part[~part["entry"]], self.ASKED), (self.learnt, part[part["entry"]], self.LEARNT)
            ):
                if len(mine):
                    state.appendValue((_packed(mine[columns]),))
            due.append(int(part["due"].min()))
        if due:
            self._wake(min(due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        asked, learnt = _unpacked(self.asked.get(), self.ASKED), _unpacked(self.learnt.get(), self.LEARNT)
        ready = asked["due"] <= now
        out = asked[ready].drop_duplicates(["id", "at"])
        if len(out):
            # of entries of one time the larger target stands
            known = learnt.sort_values(["at", "target"], na_position="first").drop_duplicates("at", keep="last")
            at, target = known["at"].to_numpy("int64"), known["target"].to_numpy(object)
            met = np.searchsorted(at, out["at"].to_numpy("int64"), "right") - 1
            valid = met >= 0
            valid[valid] = at[met[valid]] > out["low"].to_numpy("int64")[valid]
            found = np.full(len(out), None, object)
            found[valid] = target[met[valid]]
            yield pd.DataFrame({"id": out["id"].to_numpy(), "at": out["at"].to_numpy("int64"), "target": found})
        self.timer.clear()
        left = [asked[~ready], learnt[learnt["due"] > now]]
        for state, rows in zip((self.asked, self.learnt), left):
            state.clear()
            if len(rows):
                state.appendValue((_packed(rows),))
        if any(len(rows) for rows in left):
            self._wake(min(int(rows["due"].min()) for rows in left if len(rows)))

    def close(self) -> None:
        pass


def stream_tm_asof(
    stream: DataFrame, updates: DataFrame, horizon: str, delay: str = "1 hour", col: str = "text"
) -> DataFrame:
    """Each event with the memory entry valid at its time: event_id, ts, target; append mode.

    ``stream`` has event_id, ts and the text to look up, ``updates`` are the entries (fp,
    target, ts) in the order they are learnt.  An entry is valid from its time on for
    ``horizon`` (an interval such as "3 days") or until a newer one of the same
    fingerprint; of entries of one time the larger target stands.  Both sides carry a
    watermark, and a fingerprint's open events and entries are state until it has passed
    them.  A result comes out once the watermark has passed the event's second by the
    horizon; an event without a valid entry then has a null target.  Nothing is emitted
    that a later update could change.  Events find their entry by position in the sorted
    entries, so work grows with rows and not with pairs of events and entries.
    """
    kind = stream.schema["event_id"].dataType.simpleString()
    at, low = F.unix_micros("ts"), F.unix_micros(F.col("ts") - F.expr(f"INTERVAL {horizon}"))
    over = F.unix_micros(F.date_trunc("second", "ts")) + 1_000_000 + at - low
    none = F.lit(None).cast("string")
    left = stream.withWatermark("ts", delay).filter(F.col("ts").isNotNull()).select(
        F.coalesce(fingerprint(F.col(col)), F.lit("")).alias("fp"), "ts", F.lit(False).alias("entry"), at.alias("at"),
        low.alias("low"), over.alias("due"), F.col("event_id").cast("string").alias("id"), none.alias("target"),
    )
    # no event still open reaches back further than twice the horizon and its second
    right = updates.withWatermark("ts", delay).filter(F.col("ts").isNotNull() & F.col("fp").isNotNull()).select(
        "fp", "ts", F.lit(True).alias("entry"), at.alias("at"), low.alias("low"),
        (at + (at - low) * 2 + 1_000_000).alias("due"), none.alias("id"), "target",
    )
    found = (
        left.unionByName(right)
        .groupBy("fp")
        .transformWithStateInPandas(
            statefulProcessor=_AsOf(),
            outputStructType="id string, at long, target string",
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return found.select(F.col("id").cast(kind).alias("event_id"), F.timestamp_micros("at").alias("ts"), "target")
