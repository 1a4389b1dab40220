"""Queries for the streaming forms: the events files run as a stream until all input is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossweave.catalog import derived as d
from glossweave.catalog.people import CURRENT_SQL, ROUTES_SQL, SESSIONS_SQL
from glossweave.catalog.registry import query
from glossweave.functions.text import fingerprint
from glossweave.session import scratch_path, stored
from glossweave.sources import read_event_stream
from glossweave.streaming import keyed, operators as st
from glossweave.streaming.sinks import append_result, routed_result, start_append, start_routed, start_updates, update_result

# A window or session is emitted once the newest event is a delay past its end.
_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL '1 hour'"


def _zoneless(df: DataFrame) -> DataFrame:
    for name, kind in df.dtypes:
        if kind == "timestamp":
            df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


def _windows_sql(starts: str, width: str, quantiles: str = "") -> str:
    return f"""SELECT event_type, w AS window_start, w + INTERVAL '{width}' AS window_end, count(*) AS n,
          round(sum(round(value * 100)::BIGINT) / 100 / count(*), 6) AS mean, max(value) AS max{quantiles}
        FROM (SELECT event_type, value, unnest({starts}) AS w FROM events)
        WHERE w + INTERVAL '{width}' <= {_CLOSED} GROUP BY 1, 2"""


# The sketch's quantiles are judged by their ranks.
_QUANTILES = ", true AS p50_close, true AS p95_close"


@query(_windows_sql("[date_trunc('hour', ts)]", "1 hour", _QUANTILES))
def stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.stream_metrics(read_event_stream(spark, sf), "1 hour")
    found = _zoneless(append_result(rows, "metrics"))
    events = d.table(spark, sf, "events")
    keyed = events.select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window_start"), "value")
    return d.with_close_ranks(found, keyed, ["event_type", "window_start"], {"p50": 0.5, "p95": 0.95})


@query(
    _windows_sql("[date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL '1 hour']", "2 hours")
)
def stream_metrics_sliding(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.stream_metrics(read_event_stream(spark, sf), "2 hours", "1 hour", quantiles=False)
    return _zoneless(append_result(rows, "sliding"))


@query(f"SELECT * FROM ({SESSIONS_SQL.format(gap=chr(39) + '2 hours' + chr(39))}) WHERE session_end <= {_CLOSED}")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.stream_sessions(read_event_stream(spark, sf), "2 hours")
    return _zoneless(append_result(rows, "sessions"))


def _in_blocks(spark: SparkSession, sf: str, days: int, blocks: int) -> DataFrame:
    """All events with the number of the block of days they belong to."""
    events = d.table(spark, sf, "events")
    day = F.to_date("ts")
    start = events.agg(F.min(day)).first()[0]
    block = F.least(F.lit(blocks - 1), F.floor(F.date_diff(day, F.lit(start)) / days).cast("int"))
    return events.withColumn("block", block)


def _blocks_sql(days: int, blocks: int) -> str:
    return f"""SELECT *, least({blocks - 1},
        date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) // {days}) AS block FROM events"""


# All events arrive in blocks of days, each after the one before has been worked off.  A
# row's time is the start of its block, so it does not matter which row of a key is let
# through.  A key let through in block j is kept for the delay, until the watermark (the
# newest block less the delay) has passed that: after block j + 3.
_BLOCKS, _BLOCK_DAYS, _KEEP = 8, 4, 6


def _dedup_sql() -> str:
    again = -(-2 * _KEEP // _BLOCK_DAYS)
    steps = "".join(
        f""", e{j} AS (SELECT * FROM f WHERE block = {j} AND NOT EXISTS (
              SELECT 1 FROM ({" UNION ALL ".join(f"SELECT * FROM e{i}" for i in range(max(0, j - again), j))}) p
              WHERE p.user_id = f.user_id AND p.event_type = f.event_type))"""
        for j in range(1, _BLOCKS)
    )
    every = " UNION ALL ".join(f"SELECT * FROM e{j}" for j in range(_BLOCKS))
    return f"""WITH f AS (SELECT DISTINCT user_id, event_type, block FROM ({_blocks_sql(_BLOCK_DAYS, _BLOCKS)})),
             e0 AS (SELECT * FROM f WHERE block = 0){steps}
             SELECT user_id, event_type, block FROM ({every})"""


@query(_dedup_sql())
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a change notice of its user and type, in the order of the blocks."""
    rows = _in_blocks(spark, sf, _BLOCK_DAYS, _BLOCKS)
    start = F.timestamp_seconds((F.col("block") + 1) * _BLOCK_DAYS * 86_400).cast("timestamp_ntz")
    rows = stored(rows.withColumn("ts", start).withColumn("value", F.col("block").cast("double")), "blocks")
    folder, out, log = (scratch_path(spark, name) for name in ("arrivals", "dedup", "dedup_log"))
    for j in range(_BLOCKS):
        rows.filter(F.col("block") == j).drop("block").write.mode("append").parquet(folder)
        stream = st.stream_dedup(
            read_event_stream(spark, folder, "*.parquet"), ["user_id", "event_type"], f"{_KEEP} days"
        )
        picked = stream.select("user_id", "event_type", F.col("value").cast("int").alias("block"))
        start_append(picked, out, log).awaitTermination()
    return spark.read.parquet(out)


# Four blocks of eight days; every fiftieth event arrives one block late, behind the watermark.
_LATE = "(event_id % 50 = 0)"
_ARRIVALS_SQL = f"""SELECT *, least(3, block + {_LATE}::INT) AS arrival FROM ({_blocks_sql(8, 4)})"""
_TTL_HOURS = 24


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    late = F.expr(_LATE).cast("int")
    return stored(_in_blocks(spark, sf, 8, 4).withColumn("arrival", F.least(F.lit(3), F.col("block") + late)), "arrivals")


def _kept_sql(until: str) -> str:
    """The rows that are not late: whose ``until`` is past the watermark of the files before theirs."""
    return f"""b AS ({_ARRIVALS_SQL}),
      seen AS (SELECT j, max(ts) - INTERVAL '1 hour' AS wm FROM b JOIN (SELECT unnest([1, 2, 3]) AS j) ON arrival < j GROUP BY j),
      kept AS (SELECT b.* FROM b LEFT JOIN seen ON arrival = j WHERE wm IS NULL OR {until} > wm)"""


def _in_turns(spark: SparkSession, sf: str, start, make, first: int = 0) -> tuple[str, str]:
    """Append the arrivals file by file and work each off before the next; output and checkpoint."""
    rows = _arrivals(spark, sf)
    folder, out, log = (scratch_path(spark, name) for name in ("events", "turns", "turns_log"))
    for j in range(first, 4):
        rows.filter(F.col("arrival") == j).drop("block", "arrival").write.mode("append").parquet(folder)
        start(make(read_event_stream(spark, folder, "*.parquet"), rows), out, log).awaitTermination()
    return out, log


@query(
    f"""WITH {_kept_sql("date_trunc('hour', ts) + INTERVAL '1 hour'")}
      {_windows_sql("[date_trunc('hour', ts)]", "1 hour").replace("unnest([date_trunc('hour', ts)]) AS w FROM events", "unnest([date_trunc('hour', ts)]) AS w FROM kept")}"""
)
def stream_metrics_in_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly metrics of events that arrive in four files, some of them after their window has closed."""
    out, _ = _in_turns(spark, sf, start_append, lambda s, _: st.stream_metrics(s, "1 hour", quantiles=False))
    return _zoneless(spark.read.parquet(out))


@query(
    f"""WITH {_kept_sql("ts + INTERVAL '2 hours'")}
      SELECT * FROM ({SESSIONS_SQL.format(gap="'2 hours'").replace("FROM events", "FROM kept")}) WHERE session_end <= {_CLOSED}"""
)
def stream_sessions_in_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of events that arrive in four files, some of them too late."""
    out, _ = _in_turns(spark, sf, start_append, lambda s, _: st.stream_sessions(s, "2 hours"))
    return _zoneless(st.join_sessions(spark.read.parquet(out)))


@query(f"SELECT target, count(*) AS n, sum(event_id)::BIGINT AS ids FROM ({ROUTES_SQL}) GROUP BY 1")
def stream_route_in_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Events in four files, each event in its target's folder once."""
    out, _ = _in_turns(spark, sf, start_routed, lambda s, _: st.stream_route(s))
    return spark.read.parquet(out).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    f"""WITH {_kept_sql("ts")}
      SELECT user_id, session_end - INTERVAL '{_TTL_HOURS} hours' AS last_use, session_end AS expired_at, n_events AS n_uses
      FROM ({SESSIONS_SQL.format(gap=f"'{_TTL_HOURS} hours'").replace("FROM events", "FROM kept")})
      WHERE session_end <= {_CLOSED}"""
)
def stream_expire_timers(spark: SparkSession, sf: str) -> DataFrame:
    """Expiries by timers over events that arrive in four files, some of them too late."""
    with keyed.rocksdb_state(spark):
        out, _ = _in_turns(spark, sf, start_append, lambda s, _: keyed.stream_expire_timers(s, _TTL_HOURS * 3600))
    return _zoneless(spark.read.parquet(out))


@query(CURRENT_SQL)
def stream_keyed_state(spark: SparkSession, sf: str) -> DataFrame:
    """State loaded from a table of the first block, updated by three more, and read from the store."""

    def make(stream: DataFrame, rows: DataFrame) -> DataFrame:
        return keyed.stream_keyed_state(stream, keyed.state_snapshot(rows.filter("arrival = 0")))

    with keyed.rocksdb_state(spark):
        _, log = _in_turns(spark, sf, start_updates, make, first=1)
    return _zoneless(keyed.stored_state(spark, log))


# Purchases teach the memory: from then on, and for three days, their props have a translation.
_LEARNT = "'T:' || event_id::VARCHAR"


@query(
    f"""WITH learnt AS (SELECT {d.sql_fingerprint('props')} AS fp, ts, {_LEARNT} AS target FROM events WHERE event_type = 'purchase'),
      asked AS (SELECT event_id, ts, {d.sql_fingerprint('props')} AS fp FROM events WHERE event_type <> 'purchase')
      SELECT event_id, asked.ts, max_by(target, (epoch_us(learnt.ts), target)) AS target
      FROM asked LEFT JOIN learnt ON asked.fp = learnt.fp AND learnt.ts <= asked.ts AND learnt.ts > asked.ts - INTERVAL '3 days'
      WHERE date_trunc('second', asked.ts) + INTERVAL '1 second'
        <= (SELECT least(max(ts) FILTER (event_type = 'purchase'), max(ts) FILTER (event_type <> 'purchase')) FROM events) - INTERVAL '1 hour' - INTERVAL '3 days'
      GROUP BY 1, 2"""
)
def stream_tm_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Events looked up in a memory that learns while they arrive, both in four blocks."""
    rows = stored(_in_blocks(spark, sf, 8, 4), "blocks")
    asked, learnt, out, log = (scratch_path(spark, name) for name in ("asked", "learnt", "asof", "asof_log"))
    buys = F.col("event_type") == "purchase"
    for j in range(4):
        block = rows.filter(F.col("block") == j).drop("block")
        block.filter(buys).write.mode("append").parquet(learnt)
        block.filter(~buys).write.mode("append").parquet(asked)
        updates = read_event_stream(spark, learnt, "*.parquet").select(
            fingerprint(F.col("props")).alias("fp"), F.concat(F.lit("T:"), F.col("event_id").cast("string")).alias("target"), "ts"
        )
        found = keyed.stream_tm_asof(read_event_stream(spark, asked, "*.parquet"), updates, "3 days", col="props")
        with keyed.rocksdb_state(spark):
            start_append(found, out, log).awaitTermination()
    return _zoneless(spark.read.parquet(out))


@query(
    d.with_views(
        f"""SELECT event_id, t.fp IS NOT NULL AS known, t.target FROM events e
            LEFT JOIN event_memory t ON t.fp = {d.sql_fingerprint('e.props')}""",
        "event_memory",
    )
)
def stream_tm_enrich(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.stream_tm_enrich(read_event_stream(spark, sf), d.event_memory(spark, sf), "props")
    found = append_result(rows.select("event_id", "target"), "enrich")
    return found.select("event_id", F.col("target").isNotNull().alias("known"), "target")


@query(CURRENT_SQL)
def stream_current_state(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.stream_current_state(read_event_stream(spark, sf))
    return _zoneless(update_result(rows, ["user_id"], "state"))


@query(ROUTES_SQL)
def stream_route(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.stream_route(read_event_stream(spark, sf))
    return _zoneless(routed_result(rows, "routed"))


@query(
    f"""SELECT user_id, session_end - INTERVAL '24 hours' AS last_use, session_end AS expired_at,
          n_events AS n_uses
        FROM ({SESSIONS_SQL.format(gap=chr(39) + '24 hours' + chr(39))}) WHERE session_end <= {_CLOSED}"""
)
def stream_expire(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.stream_expire(read_event_stream(spark, sf), "24 hours")
    return _zoneless(append_result(rows, "expire"))
