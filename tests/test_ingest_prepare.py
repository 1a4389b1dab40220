import pytest
from pyspark.sql import functions as F

from glossweave.operators import ingest, prepare


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_extract_blocks_hides_scripts_and_keeps_order(spark):
    html = """<html><head><title>no</title></head><body><!-- <p>no</p> --><h1>One &amp;lt;</h1>
      <script>var a = "<p>no</p>";</script><p>Two <b>bold</b>
      words</p><br><div> </div><p>Three&nbsp;x</p></body></html>"""
    got = ingest.extract_blocks(pages(spark, [(1, "u", html), (2, "u", ""), (3, "u", None)])).collect()
    assert [(r.page_id, r.pos, r.text) for r in got] == [
        (1, 0, "One &lt;"),
        (1, 1, "Two bold words"),
        (1, 2, "Three x"),
    ]


def test_detect_pages(spark):
    got = ingest.detect_pages(
        pages(spark, [(1, "http://blog.x.y/en/3?page=2", "<img>"), (2, "http://x.y/", "plain"), (3, None, None)])
    ).collect()
    assert [(r.page_id, r.rules, r.score) for r in got] == [(1, "reader_path,page_param,blog_host,image", 10)]


def test_route_adapter_longest_suffix_wins(spark):
    df = pages(
        spark,
        [(1, "http://a.b.site.net/x", ""), (2, "https://SITE.net", ""), (3, "http://notsite.net/", ""), (4, None, "")],
    )
    rules = [("site.net", "short"), ("b.site.net", "long")]
    got = {r.page_id: r.adapter for r in ingest.route_adapter(df, rules, "none").collect()}
    assert got == {1: "long", 2: "short", 3: "none", 4: "none"}


def test_drop_repeated_blocks_counts_pages_not_rows(spark):
    rows = [(1, 0, "nav"), (2, 0, "nav"), (1, 1, "x"), (1, 2, "x"), (2, 1, "y")]
    df = spark.createDataFrame(rows, "page_id long, pos int, text string")
    got = sorted(r.text for r in ingest.drop_repeated_blocks(df, 2).collect())
    assert got == ["x", "x", "y"]


def test_changes_replayed_give_the_new_snapshot(spark):
    schema = "page_id long, pos int, text string"
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, None), (3, 0, "c")], schema)
    new = spark.createDataFrame([(1, 0, "a"), (1, 1, "B"), (2, 0, "n"), (4, 0, "d")], schema)
    changes = ingest.changed_blocks(old, new)
    assert sorted((r.page_id, r.change) for r in changes.collect()) == [
        (1, "update"), (2, "update"), (3, "delete"), (4, "insert"),
    ]
    assert sorted(ingest.apply_changes(old, changes).collect()) == sorted(new.collect())
    assert ingest.changed_blocks(new, new).isEmpty()


def test_sanitize_text(spark):
    df = spark.createDataFrame([("Ａｂ１　&quot;x&quot;\x00  \n y ",), (None,)], "t string")
    assert [r.t for r in prepare.sanitize_text(df, "t").collect()] == ['Ab1 "x" y', None]


def test_artifact_rules_run_in_order(spark):
    df = spark.createDataFrame([("No### way!!! ,. ok",), ("clean",)], "t string")
    rows = prepare.clean_artifacts(df, "t").collect()
    assert rows[0].t == "No way!. ok" and rows[0].hit_junk_marks and not rows[1].hit_shout
    hits = {r.rule: r.n_rows for r in prepare.artifact_hits(df, "t").collect()}
    assert hits["junk_marks"] == 1 and hits["shout"] == 1 and hits["wide_gap"] == 0


@pytest.mark.parametrize("limit", [0, 10_000])
def test_restore_sentences(spark, limit):
    rows = [(1, i, t) for i, t in enumerate(["Oh", "no.", "Run!", "and", "then"])] + [(2, 7, "Alone")]
    rows += [(3, i, "part." if i % 3 == 2 else "part") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, text string")
    got = prepare.restore_sentences(df, limit=limit).collect()
    first = sorted((r.sentence_no, r.first_pos, r.n_parts, r.text) for r in got if r.doc_id == 1)
    assert first == [(0, 0, 2, "Oh no."), (1, 2, 1, "Run!"), (2, 3, 2, "and then")]
    third = sorted((r.sentence_no, r.first_pos, r.n_parts) for r in got if r.doc_id == 3)
    assert third == [(i, 3 * i, 3 if i < 16 else 2) for i in range(17)]


def test_classify_text_first_rule_wins(spark):
    df = spark.createDataFrame([("...",), ("BOOM!!",), ("(later)",), ("Hello.",), ("hello",)], "text string")
    got = [r.text_class for r in prepare.classify_text(df).collect()]
    assert got == ["noise", "sound", "caption", "speech", "other"]


def test_script_profile_inline_scripts(spark):
    rows = [("日本のマンガ",), ("漫画翻译",), ("만화",), ("manga",), ("123",), ("漢字漢字かな",)]
    got = prepare.script_profile(spark.createDataFrame(rows, "text string")).collect()
    assert [r.lang_bucket for r in got] == ["ja", "zh", "ko", "latin", "none", "ja"]
    assert got[1].dominant_script == "han" and got[1].n_han == 4


def test_dedup_content(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_copies) for r in prepare.dedup_content(df, "text", "doc_id").collect())
    assert got == [(1, 2), (2, 1)]


def test_text_classifier_learns_a_plain_rule(spark):
    docs = spark.createDataFrame(
        [(i, "good fine text" if i % 2 else "bad junk noise") for i in range(40)], "doc_id long, text string"
    )
    labels = docs.filter("doc_id < 30").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    scored = prepare.score_text(prepare.train_text_classifier(docs, labels), docs).collect()
    assert len(scored) == 40 and all(r.predicted == r.doc_id % 2 for r in scored)


def test_text_classifier_sees_repeats_and_takes_stored_features(spark):
    """Few labels: words repeated in a row, or divided by bare marks, tell the held-out texts apart."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def words(i, n=20):
        return [letters[(i * 7 + j * 3) % 26] + letters[(i + j * 5) % 26] * 2 + letters[(i * j) % 26] for j in range(n)]

    def text(i):
        if i % 6 == 0:
            return " ".join(w for w in words(i, 10) for _ in range(2))
        return " | ".join(words(i)) if i % 6 == 3 else " ".join([*words(i, 10), *reversed(words(i, 10))])

    docs = spark.createDataFrame([(i, text(i)) for i in range(90)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    described = prepare.text_features(docs)
    first = described.filter("doc_id in (0, 3)").orderBy("doc_id").collect()
    assert first[0]["_repeats"] == 0.5 and first[0]["_bare"] == 0 and first[1]["_bare"] == 19 / 39
    model = prepare.train_text_classifier(described, labels.filter("doc_id < 60"))
    scored = prepare.score_text(model, described)
    assert prepare.ranking_quality(scored, labels.filter("doc_id >= 60")) > 0.95
    assert sorted(scored.collect()) == sorted(prepare.score_text(model, docs).collect())
