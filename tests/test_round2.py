"""Cases where a switch, a cap or a null once changed a result."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from glossweave.functions.text import words
from glossweave.operators import layout, memory, prepare, privacy, terms


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def greedy(rows, t):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[0])):
        if all(k[1] != r[1] or iou(k[2:6], r[2:6]) < t for k in kept):
            kept.append(r)
    return {r[0] for r in kept}


BOXES = "id int, page int, x0 int, y0 int, x1 int, y1 int, score int"


@pytest.mark.parametrize("fold", [500, 40])
def test_greedy_chain_and_crowd(spark, monkeypatch, fold):
    monkeypatch.setattr(layout, "FOLD", fold)
    chain = [(i, 1, 10 * i, 0, 10 * i + 20, 20, 1000 - i) for i in range(500 if fold == 500 else 60)]
    rnd = random.Random(2)
    crowd = []
    for i in range(1000, 1150):
        x, y = rnd.randrange(200), rnd.randrange(200)
        crowd.append((i, 2, x, y, x + rnd.randrange(10, 60), y + rnd.randrange(10, 60), rnd.randrange(9)))
    rows = chain + crowd
    got = layout.suppress_overlaps(spark.createDataFrame(rows, BOXES), 0.3, "greedy")
    assert {r.id for r in got.collect()} == greedy(rows, 0.3)


@pytest.mark.parametrize("direction", ["rtl", "ltr", "vertical"])
def test_reading_order_of_fractional_boxes(spark, direction):
    rnd = random.Random(3)
    rows = [(i, 1, 0, *(rnd.random() * 300 for _ in range(2)), 400 + rnd.random(), 400 + rnd.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, page int, panel_no int, x0 double, y0 double, x1 double, y1 double")
    plain = {(r.id, r.ord) for r in layout.reading_order(df, direction).collect()}
    assert {(r.id, r.ord) for r in layout.reading_order(df, direction, limit=5).collect()} == plain


def test_vertical_columns_run_from_the_right(spark):
    rows = [(1, 1, 0, 200, 0, 240, 50), (2, 1, 0, 200, 60, 240, 90), (3, 1, 0, 100, 0, 140, 90), (4, 1, 0, 0, 5, 40, 9)]
    df = spark.createDataFrame(rows, "id int, page int, panel_no int, x0 int, y0 int, x1 int, y1 int")
    assert [r.id for r in layout.reading_order(df, "vertical").orderBy("ord").collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("limit", [1, 2, 1000])
def test_null_consent_changes_nothing(spark, limit):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    events = spark.createDataFrame([(i, 1, at(i)) for i in range(0, 30, 5)], "event_id int, user_id int, ts timestamp")
    consent = spark.createDataFrame(
        [(1, "granted", at(3)), (1, None, at(8)), (1, "revoked", at(28))], "user_id int, state string, ts timestamp"
    )
    assert {r.event_id for r in privacy.apply_consent(events, consent, limit=limit).collect()} == {5, 10, 15, 20, 25}


@pytest.mark.parametrize("limit", [2, 1000])
def test_time_as_order(spark, limit):
    rows = [(1, dt.datetime(2024, 1, 1, i), f"part {i}" + ("." if i % 4 == 3 else "")) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id int, at timestamp, text string").withColumn("work", F.col("doc_id"))
    context = {r.at.hour: r.context for r in memory.context_window(df, 2, order="at", limit=limit).collect()}
    assert context[0] == "" and context[9] == "part 7. part 8"
    joined = prepare.restore_sentences(df, order="at", limit=limit).orderBy("sentence_no").collect()
    assert [r.n_parts for r in joined] == [4] * 5


def test_eviction_with_missing_times(spark):
    rows = [("a", "x" * 5, "", None, 1), ("b", "y" * 5, "", dt.datetime(2024, 1, 2), 1), ("c", "z" * 5, "", dt.datetime(2024, 1, 1), 1)]
    tm = spark.createDataFrame(rows, "fp string, source string, target string, ts timestamp, uses int")
    for budget, want in ((15, set()), (10, {"a"}), (5, {"a", "c"}), (0, {"a", "b", "c"})):
        assert {r.fp for r in memory.tm_evict(tm, budget).collect()} == want


def test_files_without_content(spark):
    files = spark.createDataFrame([("a", None), ("b", "x"), ("d", None)], "path string, content string")
    sums = spark.createDataFrame([("a", "00"), ("c", "11"), ("d", None)], "path string, sha256 string")
    got = {r.path: r.status for r in privacy.integrity_audit(files, sums).collect()}
    assert got == {"a": "changed", "b": "extra", "c": "missing", "d": "matched"}


def test_words_of_any_script(spark):
    rows = [("Page 22, été!",), ("吾輩は猫である",), ("ภาษา",), (None,)]
    got = [r.w for r in spark.createDataFrame(rows, "t string").select(words(F.col("t")).alias("w")).collect()]
    assert got[0] == ["page", "22", "été"] and got[1] == list("吾輩は猫である") and len(got[2]) == 4 and got[3] is None


def test_near_matches_in_japanese_and_with_numbers(spark):
    seg = spark.createDataFrame([("私は昨日東京の大学へ行きました",), ("Chapter one page 1",)], "text string")
    tm = spark.createDataFrame(
        [("j", "私は昨日東京の大学に行きました"), ("e", "Chapter one page 22"), ("z", "我们今天去学校")], "fp string, source string"
    )
    got = {r.tm_fp: r.sim for r in memory.tm_fuzzy(seg, tm, 0.5).collect()}
    assert got["j"] == pytest.approx(12 / 16) and got["e"] == pytest.approx(0.5) and "z" not in got


@pytest.mark.parametrize("small", [True, False])
def test_glossary_terms_of_several_words(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(terms, "SMALL_TERMS", 0)
    seg = spark.createDataFrame([(1, 0, "吾輩は猫である。猫"), (1, 1, "the Spirit Realm, the"), (2, 0, "…"), (2, 1, None)], "doc_id int, pos int, text string")
    words_ = spark.createDataFrame([("猫",), ("吾輩",), ("spirit realm",), ("the",), ("",)], "term string")
    got = {(r.doc_id, r.pos): (r.n_words, r.n_hits) for r in terms.annotate_terms(seg, words_).collect()}
    assert got == {(1, 0): (8, 3), (1, 1): (4, 3)}


@pytest.mark.parametrize("small", [True, False])
def test_long_terms_are_met_behind_their_first_word_only(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(terms, "SMALL_TERMS", 0)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    glossary = {" ".join(rng.choices(vocabulary, k=k)) for k in (1, 1, 2, 2, 2, 3, 3, 4) for _ in range(6)}
    long_term = " ".join(rng.choices(vocabulary, k=30))
    glossary |= {long_term, "w1 w1"}
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 80))) for _ in range(30)] + [f"w1 w1 w1 {long_term}", "x " + long_term[:-1]]
    want = {}
    for i, text in enumerate(texts):
        ws = text.split()
        want[i] = sum(ws[a:b] == t.split() for t in glossary for a in range(len(ws)) for b in [a + len(t.split())])
    seg = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("pos", F.lit(0))
    found = terms.annotate_terms(seg, spark.createDataFrame([(t,) for t in glossary], "term string"))
    assert {r.doc_id: r.n_hits for r in found.collect()} == want


def test_honorifics_of_both_scripts(spark):
    texts = ["Mary-Jane-san met Bo-sama and Al-sanity", "明さんと田中先生がマリアちゃんへ", "a.b-c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [(r["name"], r["honorific"]) for r in terms.scan_honorifics(df).orderBy("id", "mention_no").collect()]
    assert got == [("Mary-Jane", "san"), ("Bo", "sama"), ("明", "さん"), ("田中", "先生"), ("マリア", "ちゃん")]
    odd = terms.scan_honorifics(df, ["b.c", "sa("], japanese=[])
    assert odd.count() == 0


def test_chinese_variants(spark):
    rows = [("我们在学校学习汉语",), ("我們在學校學習漢語",), ("中文",), ("日本の学校",), ("plain",)]
    got = prepare.script_profile(spark.createDataFrame(rows, "text string")).collect()
    assert [r.zh_variant for r in got] == ["simplified", "traditional", None, None, None]
