import datetime as dt

import pytest
from pyspark.sql import functions as F

from glossweave.functions.text import fingerprint
from glossweave.operators import state
from glossweave.sources import read_event_stream
from glossweave.streaming import operators as st
from glossweave.streaming.sinks import append_result, routed_result, start_routed, update_result

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

# Four files, read one per batch: the last brings a row that is too late.
BATCHES = [
    [(0, 0, 1, "view", 1.0), (1, 10, 1, "click", 2.0), (2, 15, 2, "view", 3.0)],
    [(3, 200, 1, "view", 4.0), (4, 230, 2, "error", 5.0)],
    [(6, 600, 3, "odd", 6.0), (7, 605, 1, "view", 7.0)],
    [(5, 5, 1, "view", 100.0), (8, 610, 1, "view", 8.0)],
]
LATE = 5


@pytest.fixture()
def folder(spark, tmp_path):
    for i, rows in enumerate(BATCHES):
        data = [(e, T0 + dt.timedelta(minutes=m), u, k, v, "{}") for e, m, u, k, v in rows]
        out = str(tmp_path / f"b{i}")
        spark.createDataFrame(data, EVENTS).coalesce(1).write.parquet(out)
        part = next((tmp_path / f"b{i}").glob("part-*.parquet"))
        target = tmp_path / "in" / f"events-{i}.parquet"
        target.parent.mkdir(exist_ok=True)
        part.rename(target)
        stamp = 1_700_000_000 + i * 10
        import os

        os.utime(target, (stamp, stamp))
    return str(tmp_path / "in")


def stream(spark, folder):
    return read_event_stream(spark, folder, max_files=1)


def batch(spark, folder, late=False):
    df = spark.read.parquet(folder)
    return df if late else df.filter(F.col("event_id") != LATE)


def test_event_stream_reads_every_file_once(spark, folder):
    got = append_result(stream(spark, folder), "t").collect()
    assert sorted(r.event_id for r in got) == list(range(9))


def test_metrics_drop_late_rows_and_equal_batch_on_closed_windows(spark, folder):
    rows = append_result(st.stream_metrics(stream(spark, folder), "1 hour", delay="1 hour"), "t").collect()
    got = {(r.event_type, r.window_start, r.n, r["mean"], r["max"]) for r in rows}
    want = {
        (r.event_type, r.window_start, r.n, r["mean"], r["max"])
        for r in state.performance_metrics(batch(spark, folder), "1 hour").collect()
        if r.window_start + dt.timedelta(hours=1) <= T0 + dt.timedelta(minutes=610 - 60)
    }
    assert got == want


def test_sliding_windows_overlap(spark, folder):
    rows = append_result(st.stream_metrics(stream(spark, folder), "2 hours", "1 hour"), "t").collect()
    assert sum(r.n for r in rows if r.event_type == "error") == 2


def test_sessions_and_expiry_do_not_depend_on_batches(spark, folder):
    got = append_result(st.stream_sessions(stream(spark, folder), "60 minutes"), "t").collect()
    want = [r for r in state.sessionize(batch(spark, folder), 3600).collect()
            if r.session_end <= T0 + dt.timedelta(minutes=610 - 60)]
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)

    expired = append_result(st.stream_expire(stream(spark, folder), "60 minutes"), "t").collect()
    assert sorted((r.user_id, r.last_use, r.n_uses) for r in expired) == sorted(
        (r.user_id, r.session_end - dt.timedelta(hours=1), r.n_events) for r in want
    )


def test_dedup_inside_the_watermark(spark, folder):
    rows = append_result(st.stream_dedup(stream(spark, folder), ["user_id", "event_type"], "1 hour"), "t").collect()
    # The key is forgotten after the batch that sees the watermark pass its hour.
    views = sorted(r.event_id for r in rows if r.user_id == 1 and r.event_type == "view")
    assert views == [0, 8]
    assert len(rows) == 6


def test_tm_enrich_keeps_misses(spark, folder):
    tm = spark.createDataFrame([("click",)], "source string").select(
        fingerprint(F.col("source")).alias("fp"), F.lit("T").alias("target")
    )
    rows = append_result(st.stream_tm_enrich(stream(spark, folder), tm, "event_type"), "t").collect()
    assert {r.event_id for r in rows if r.target == "T"} == {1} and len(rows) == 9


def test_current_state_over_batches_equals_batch(spark, folder):
    got = update_result(st.stream_current_state(stream(spark, folder)), ["user_id"], "t").collect()
    want = state.current_state(batch(spark, folder, late=True)).collect()
    assert sorted((r.user_id, r.state) for r in got) == sorted((r.user_id, r.state) for r in want)


def test_route_writes_one_folder_per_target_and_is_idempotent(spark, folder, tmp_path):
    rows = st.stream_route(stream(spark, folder))
    assert len(routed_result(rows, "t").collect()) == 9
    out = str(tmp_path / "routed")
    for attempt in range(2):  # a second run with a fresh log repeats every batch id
        start_routed(st.stream_route(stream(spark, folder)), out, str(tmp_path / f"log{attempt}")).awaitTermination()
    back = spark.read.parquet(out)
    assert back.count() == 9
    assert {r.target for r in back.filter("event_type = 'odd'").collect()} == {"reject"}
