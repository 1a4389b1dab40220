import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from glossweave.operators import privacy, state, terms

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, rows):
    return spark.createDataFrame(
        [(i, T0 + dt.timedelta(seconds=s), u, k, v, "{}") for i, (s, u, k, v) in enumerate(rows)], EVENTS
    )


def test_honorifics_including_non_latin_names(spark):
    df = spark.createDataFrame([(1, "Aki-san, 明-kun and Bo-sama"), (2, "Aki-chan"), (3, "none")], "id long, text string")
    m = terms.scan_honorifics(df)
    assert sorted((r.id, r.mention_no, r.name, r.honorific) for r in m.collect()) == [
        (1, 0, "Aki", "san"), (1, 1, "明", "kun"), (1, 2, "Bo", "sama"), (2, 0, "Aki", "chan"),
    ]
    got = terms.honorific_consistency(m).collect()
    assert [(r.name, r.honorifics, r.n_honorifics, r.n_mentions) for r in got] == [("Aki", "chan,san", 2, 2)]


def test_sfx_lookup_collapses_stretched_forms(spark):
    tokens = spark.createDataFrame([(1, "Booom"), (2, "ドドド"), (3, "hm")], "id long, token string")
    sfx = spark.createDataFrame([("bom", "BANG"), ("ド", "rumble")], "form string, translation string")
    got = {r.id: (r.form, r.translation) for r in terms.sfx_lookup(tokens, sfx).collect()}
    assert got == {1: ("bom", "BANG"), 2: ("ド", "rumble"), 3: ("hm", None)}


def test_annotate_terms_coverage(spark):
    seg = spark.createDataFrame([(1, 0, "The cat, the hat"), (1, 1, "1-2 ..."), (1, 2, "...")], "doc_id long, pos int, text string")
    glossary = spark.createDataFrame([("the",), ("hat",), ("the",)], "term string")
    got = terms.annotate_terms(seg, glossary).collect()
    assert [(r.pos, r.n_words, r.n_hits, r.coverage) for r in sorted(got)] == [
        (0, 4, 3, 0.75), (1, 2, 0, 0.0),
    ]


def test_catalog_coverage_missing_and_extra(spark):
    rows = [("en", "a", "A"), ("en", "b", "B"), ("ja", "a", "あ"), ("ko", "b", "ㅂ"), ("ko", "z", "?")]
    got = terms.catalog_coverage(spark.createDataFrame(rows, "lang string, key string, value string")).collect()
    assert sorted((r.lang, r.key, r.status, r.fallback) for r in got if r.status == "missing") == [
        ("ja", "b", "missing", "B"), ("ko", "a", "missing", "A"),
    ]
    assert [(r.lang, r.key, r.fallback) for r in got if r.status == "extra"] == [("ko", "z", None)]


def test_recent_history_breaks_ties_by_id(spark):
    df = events(spark, [(0, 1, "a", 1.0), (0, 1, "b", 1.0), (5, 2, "c", 1.0)])
    got = [(r.user_id, r.event_id, r["rank"]) for r in state.recent_history(df, 1).collect()]
    assert sorted(got) == [(1, 1, 1), (2, 2, 1)]


def test_sessionize_equals_session_window(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(20_000), 1 if rnd.random() < 0.5 else rnd.randrange(9), "v", 1.0) for _ in range(400)]
    rows += [(100_000, 1, "v", 1.0), (100_600, 1, "v", 1.0), (101_199, 1, "v", 1.0)]
    df = events(spark, rows)
    got = {tuple(r) for r in state.sessionize(df, 600).collect()}
    want = {
        (r.user_id, r.w.start, r.w.end, r.n)
        for r in df.groupBy("user_id", F.session_window("ts", "600 seconds").alias("w")).agg(F.count("*").alias("n")).collect()
    }
    assert got == want


def test_resolve_settings_most_specific_layer_wins(spark):
    user = spark.createDataFrame([(1, "a", "u"), (1, "x", "u")], "user_id long, key string, value string")
    device = spark.createDataFrame(
        [(1, 1, "a", "d"), (1, 2, "q", "d"), (2, 1, "b", None)], "user_id long, device long, key string, value string"
    )
    got = {
        (r.user_id, r.device, r.key): (r.value, r.layer)
        for r in state.resolve_settings({"a": "0", "b": "0"}, user, device).collect()
    }
    assert got[(1, 1, "a")] == ("d", "device") and got[(1, 2, "a")] == ("u", "user")
    assert got[(2, 1, "b")] == ("0", "default") and got[(1, 2, "q")] == ("d", "device")
    assert got[(1, 1, "x")] == ("u", "user") and (2, 1, "x") not in got


def test_sync_merge_reports_conflicts(spark):
    rows = [(1, 0, "k", "a", 1), (1, 1, "k", "b", 2), (1, 0, "j", "a", 1), (1, 1, "j", "a", 0), (1, 0, "k", "z", 0)]
    df = spark.createDataFrame(rows, "user_id long, device long, key string, value string, t int").withColumn(
        "ts", F.timestamp_seconds("t").cast("timestamp_ntz")
    )
    got = {r.key: (r.value, r.device, r.n_devices, r.n_values, r.conflict) for r in state.sync_merge(df).collect()}
    assert got == {"k": ("b", 1, 2, 2, True), "j": ("a", 0, 2, 1, False)}


def test_current_state_and_routes(spark):
    df = events(spark, [(0, 1, "view", 1.0), (9, 1, "click", 1.0), (9, 1, "odd", 1.0)])
    assert [(r.user_id, r.state) for r in state.current_state(df).collect()] == [(1, "odd")]
    assert [r.target for r in state.route_events(df).collect()] == ["page_scan", "overlay", "reject"]


def test_performance_metrics_exact_and_approximate(spark):
    df = events(spark, [(i, 1, "view", float(i)) for i in range(1, 101)])
    exact = state.performance_metrics(df, "1 hour", exact=True).first()
    assert (exact.n, exact["mean"], exact.p50, exact.p95, exact["max"]) == (100, 50.5, 50.5, 95.05, 100.0)
    approx = state.performance_metrics(df, "1 hour").first()
    assert abs(approx.p50 - 50.5) <= 1 and abs(approx.p95 - 95) <= 1


def test_retention_boundary_and_unlisted_class(spark):
    day = 86_400
    df = events(spark, [(0, 1, "view", 1.0), (day, 1, "view", 1.0), (0, 1, "signup", 1.0)])
    kept = privacy.apply_retention(df, {"view": 7}, "2024-01-09")
    assert sorted(r.event_id for r in kept.collect()) == [1, 2]
    report = {r.event_type: (r.n_kept, r.n_expired, r.ttl_days) for r in privacy.retention_report(df, {"view": 7}, "2024-01-09").collect()}
    assert report == {"view": (1, 1, 7), "signup": (1, 0, None)}


@pytest.mark.parametrize("limit", [0, 10_000])
def test_consent_never_looks_forward(spark, limit):
    rnd = random.Random(7)
    consent = [(rnd.randrange(3), rnd.choice(["granted", "revoked"]), rnd.randrange(20_000)) for _ in range(40)]
    rows = [(rnd.randrange(20_000), 0 if rnd.random() < 0.6 else rnd.randrange(4), "view", 1.0) for _ in range(200)]
    rows += [(consent[0][2], consent[0][0], "view", 1.0)]
    df = events(spark, rows)
    cdf = spark.createDataFrame(
        [(u, s, T0 + dt.timedelta(seconds=t)) for u, s, t in consent], "user_id long, state string, ts timestamp_ntz"
    )
    got = {r.event_id for r in privacy.apply_consent(df, cdf, limit=limit).collect()}
    want = set()
    for i, (s, u, _, _) in enumerate(rows):
        past = sorted((t, st) for cu, st, t in consent if cu == u and t <= s)
        if past and past[-1][1] == "granted":
            want.add(i)
    assert got == want


def test_anonymize(spark):
    text = 'mail a.b@x.example.com from 10.0.0.1 token = "abcdefabcdef1234" or +1 (555) 123-4567'
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = privacy.anonymize(df, "text", ["doc_id"], "s").collect()
    assert rows[0].text == "mail [EMAIL] from [IP] [TOKEN] or [PHONE]"
    assert (rows[0].n_email, rows[0].n_ip, rows[0].n_token, rows[0].n_phone) == (1, 1, 1, 1)
    other = privacy.anonymize(df, "text", ["doc_id"], "t").collect()
    assert len(rows[0].doc_id) == 64 and rows[0].doc_id != other[0].doc_id


def test_k_anonymity(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "q string, r int")
    assert [(r.q, r.n) for r in privacy.k_anonymity(df, ["q", "r"], 2).collect()] == [("b", 1)]


def test_protect_columns_round_trip(spark):
    key = F.lit("k" * 32).cast("binary")
    df = spark.createDataFrame([("é",), ("é",), (None,)], "v string")
    hidden = privacy.protect_columns(df, ["v"], key)
    vals = [r.v for r in hidden.collect()]
    assert vals[2] is None and vals[0] != vals[1]
    assert [r.v for r in privacy.reveal_columns(hidden, ["v"], key).collect()] == ["é", "é", None]
    with pytest.raises(Exception):
        privacy.reveal_columns(hidden, ["v"], F.lit("x" * 32).cast("binary")).collect()


def test_integrity_audit(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, content string")
    sums = files.filter("path != 'd'").select(
        "path", F.sha2(F.when(F.col("path") == "b", "x").otherwise(F.col("content")), 256).alias("sha256")
    ).union(spark.createDataFrame([("c", "0")], "path string, sha256 string"))
    got = {r.path: r.status for r in privacy.integrity_audit(files, sums).collect()}
    assert got == {"a": "matched", "b": "changed", "c": "missing", "d": "extra"}
