"""Every operator on empty tables, nulls, ties, repeated rows, long texts and clashing columns."""

import pytest
from pyspark.sql import functions as F

from glossweave.llm import html_text, language, licenses, personal_data, url_filter
from glossweave.llm.decontaminate import contaminated, decontaminate
from glossweave.llm.exact_dedup import exact_dedup, keep_one
from glossweave.llm.mixing import mix, repeated
from glossweave.llm.quality import keep_good, quality_scores
from glossweave.llm.simhash import keep_representatives, simhash_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "x" * 100_000 + " 1.2.3.4"
ROWS = [
    (1, "The same text, twice.", "en", "a", 21),
    (2, "the same text, twice.", None, None, None),
    (3, None, None, None, None),
    (4, "", "en", "", 0),
    (5, " \t\n", "en", "a", 3),
    (6, LONG, "de", "b", len(LONG)),
    (7, "12 345 — !?", "fr", "b", 10),
    (8, "État \U0001f600 café 中文", "fr", "b", 14),
    (8, "État \U0001f600 café 中文", "fr", "b", 14),
    (None, "No id at all, mail me@example.org", "en", "c", 20),
]
CLASHING = (
    "size", "unit", "draw", "copies", "taken", "digest", "fp", "cell", "score", "predicted", "label",
    "key", "_id", "item", "value", "kind", "pattern", "added", "email", "row_hash", "component_id", "keep_id",
)
LABELS = [(1, 1), (2, 0), (4, 0), (6, 1), (8, None), (None, 1), (99, 1)]
ITEMS = [(1, "twice."), (2, None), (3, " . "), (4, "The same text"), (4, "The same text")]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.createDataFrame(ROWS, SCHEMA)
    for name in CLASHING:
        table = table.withColumn(name, F.lit("clash"))
    return table


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int").withColumn("text", F.lit("clash"))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(0))


PER_ROW = {
    "exact": lambda d, lab, it: exact_dedup(d),
    "simhash": lambda d, lab, it: simhash_groups(d),
    "mix": lambda d, lab, it: mix(d),
    "quality": lambda d, lab, it: quality_scores(d, lab),
    "language": lambda d, lab, it: language.identify(d, language.fit(d)),
    "personal": lambda d, lab, it: personal_data.digest(personal_data.find_personal_data(d)),
    "urls": lambda d, lab, it: url_filter.judge_urls(d, "doc_id", "text"),
    "html": lambda d, lab, it: html_text.extract(d, "doc_id", "source", "text"),
}
SOME_ROWS = {
    "licenses": lambda d, lab, it: licenses.scan_licenses(d),
    "contaminated": lambda d, lab, it: contaminated(d, it),
}
FILTERS = {
    "keep_one": lambda d, lab, it: keep_one(d),
    "representatives": lambda d, lab, it: keep_representatives(d),
    "keep_good": lambda d, lab, it: keep_good(d, lab),
    "decontaminate": lambda d, lab, it: decontaminate(d, it),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_row(docs, labels, items, name):
    rows = PER_ROW[name](docs, labels, items).collect()
    assert len(rows) == len(ROWS)
    key = "page_id" if name in ("urls", "html") else "doc_id"
    assert sorted(str(r[key]) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", [*PER_ROW, *SOME_ROWS, *FILTERS])
def test_empty_tables(docs, labels, items, name):
    run = {**PER_ROW, **SOME_ROWS, **FILTERS}[name]
    none = [t.filter("1 = 0") for t in (docs, labels, items)]
    assert run(*none).collect() == []
    if name not in FILTERS:
        assert run(none[0], labels, items).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_all_columns(docs, labels, items, name):
    kept = FILTERS[name](docs, labels, items)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} <= {r[0] for r in ROWS}


def test_exact_dedup_by_rule(docs):
    got = {r["doc_id"]: r for r in exact_dedup(docs).collect()}
    assert (got[1]["keep_id"], got[1]["group_size"], got[1]["kept"]) == (2, 2, False)
    assert got[2]["kept"] and got[3]["keep_id"] == 4 and got[4]["group_size"] == 2
    assert got[8]["group_size"] == 2 and got[None]["kept"]
    assert got[3]["text_sha256"] == got[4]["text_sha256"] != got[5]["text_sha256"]


def test_keep_one_leaves_one_of_repeated_rows(docs):
    kept = sorted((str(r["doc_id"]) for r in keep_one(docs).collect()))
    assert kept == sorted(map(str, [2, 4, 5, 6, 7, 8, None]))


def test_blank_texts_share_fingerprint_zero(docs):
    got = {r["doc_id"]: r for r in simhash_groups(docs).collect()}
    for i in (3, 4, 5):
        assert got[i]["fingerprint"] == "0" * 16 and got[i]["component_id"] == 3
    assert got[1]["component_id"] == got[2]["component_id"] == 1


def test_undetermined_languages(docs):
    got = {r["doc_id"]: r for r in PER_ROW["language"](docs, None, None).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5, 7))
    assert got[8]["lang_pred"] == "fr"


def test_nothing_to_learn_from(docs, labels):
    scores = {r["score"] for r in quality_scores(docs, labels.filter("1 = 0")).collect()}
    assert scores == {0.5}
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in PER_ROW["language"](bare, None, None).collect()} == {"und"}


def test_mix_of_blank_documents(docs):
    plan = {r["doc_id"]: r for r in mix(docs).collect()}
    assert plan[3]["size"] == plan[4]["size"] == plan[5]["size"] == 0 == plan[5]["taken"]
    assert all(r["taken"] <= 2 * r["size"] for r in plan.values())
    whole = docs.filter("doc_id in (1, 2, 6, 7)")
    p = mix(whole)
    assert repeated(whole, p).count() == sum(r["copies"] for r in p.collect())


def test_contaminated_rows(docs, items):
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in contaminated(docs, items).collect()}
    assert got == {(1, 1, 0), (2, 1, 0), (1, 4, 0), (2, 4, 0)}
    assert {r["doc_id"] for r in decontaminate(docs, items).collect()} == {3, 4, 5, 6, 7, 8, None}
