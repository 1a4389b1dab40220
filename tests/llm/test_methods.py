"""The method behind each operator, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from glossweave.llm import html_text, licenses, personal_data, url_filter
from glossweave.llm import quality as q
from glossweave.llm.decontaminate import Matcher, best_match, contaminated, item_blocks, normal, original_span
from glossweave.llm.exact_dedup import CuckooIndex, digest_rows, update_index
from glossweave.llm.graph import components
from glossweave.llm.language import Model, Scorer
from glossweave.llm.mixing import mix
from glossweave.llm.simhash import cell_of, near_pairs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 400)), max_size=1500))
def test_cuckoo_index_is_a_dictionary(steps):
    index, want = CuckooIndex(2), {}
    for put, n in steps:
        key = hashlib.sha256(str(n).encode()).digest()
        if put:
            index.put(key, n)
            want[key] = n
        else:
            assert index.delete(key) == (want.pop(key, None) is not None)
    assert dict(index.items()) == want and index.live == len(want)
    assert all(index.get(k) == v for k, v in want.items())


def test_cuckoo_index_verifies_hits_and_resizes():
    index = CuckooIndex(1)
    same = [b"\0" * 8 + b"\1\1" + bytes([i]) for i in range(6)]  # one bucket, one fingerprint
    for i, key in enumerate(same):
        index.put(key, i)
    assert [index.get(k) for k in same] == list(range(6)) and index.buckets > 1


def test_index_updates(spark):
    rows = spark.createDataFrame([(i, f"t{i % 40}") for i in range(300)], "doc_id long, text string")
    digests = digest_rows(rows)
    index = update_index(None, digests, None)
    assert index.count() == 300
    gone = digests.filter("doc_id < 100")
    after = update_index(index, digests.filter("doc_id < 10"), gone.unionByName(digests.filter("doc_id = 5")))
    assert {r["doc_id"] for r in after.collect()} == {*range(10), *range(100, 300)}


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (2000, 2001)] * 2
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1100)} | {2000: 2000, 2001: 2000}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(400)}
    for _ in range(8):
        centre = rng.getrandbits(64)
        fps |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)} | {centre}
    fps |= {0, 1, 3, 7, 2**64 - 1, 2**63, 2**63 + 1}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = [tuple(sorted((r["a"], r["b"]))) for r in near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    want = {
        tuple(sorted((a, b)))
        for i, a in enumerate(signed)
        for b in signed[:i]
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    }
    assert len(got) == len(set(got)) and set(got) == want


def test_near_pairs_leave_the_copied_rows_on_the_executors(spark):
    # 235,650 fingerprints were sized below the limit of a broadcast, and one side has 17 times as many rows
    fps = spark.range(20_000).select(F.xxhash64("id").alias("fp"))
    plan = near_pairs(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_cells_bound_the_distance(spark):
    rng = random.Random(4)
    rows = [(rng.getrandbits(64) - 2**63,) for _ in range(50)]
    cells = {r["fp"]: r["c"] for r in spark.createDataFrame(rows, "fp long").select("fp", cell_of(F.col("fp")).alias("c")).collect()}
    vector = lambda c: [(c >> (3 * i)) & 7 for i in range(16)]
    for (a, ca), (b, cb) in zip(cells.items(), list(cells.items())[1:]):
        assert sum(abs(x - y) for x, y in zip(vector(ca), vector(cb))) <= ((a ^ b) & (2**64 - 1)).bit_count()


def _distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row = row, [i] * (len(text) + 1)
        for j, c in enumerate(text, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (p != c))
    best = min(row)
    return best, row.index(best)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=70), st.text("abc ", max_size=120))
def test_bit_parallel_distance(pattern, text):
    best, end = _distance(pattern, text)
    budget = len(pattern) // 2
    want = (best, end) if best <= budget and end else None
    got = best_match(pattern, text, budget)
    assert (got and got[0]) == (want and want[0])


def test_matches_equal_brute_force():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 14)))) for i in range(25)]
    matcher = Matcher(items, 0.15)
    for _ in range(40):
        text = " ".join(rng.choices(words, k=40))
        if rng.random() < 0.7:
            body = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 5)):
                body[rng.randrange(len(body))] = rng.choice(["", "x", "yy"])
            text += " " + "".join(body) + " end"
        got = {matcher.items[i][0]: hit[0] for i, hit in matcher.search(text).items()}
        want = {}
        for key, item in items:
            best, _ = _distance(normal(item), normal(text))
            if best <= int(0.15 * len(normal(item))):
                want[key] = best
        assert got == want


def test_spans_and_blocks(spark):
    text = "A  b!! Hello,\nWorld of été."
    start = normal(text).index("hello")
    assert text[slice(*original_span(text, start, start + len("hello world")))] == "Hello,\nWorld"
    items = spark.createDataFrame([(i, f"item number {i} with words") for i in range(50)], "item_id long, text string")
    blocks = list(item_blocks(items, "item_id", "text", 200))
    assert len(blocks) > 3 and sorted(i for b in blocks for i, _ in b) == list(range(50))
    docs = spark.createDataFrame([(i, f"so: item NUMBER {i} with words!") for i in range(0, 50, 7)], "doc_id long, text string")
    got = contaminated(docs, items, rate=0.0).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(0, 50, 7)}


def test_machine_uses_the_identity():
    rng = np.random.default_rng(1)
    machine = q.Machine(0.3, rng.normal(size=q.SIZE), rng.normal(size=(q.SIZE, q.RANK)))
    rows = [q.features(t) for t in ("One two, three two.", "", "x | y | z !!")]
    for (index, value), score in zip(rows, machine.score(rows)):
        total = 0.3 + sum(machine.linear[i] * v for i, v in zip(index, value))
        for a in range(len(index)):
            for b in range(a):
                total += machine.factors[index[a]] @ machine.factors[index[b]] * value[a] * value[b]
        assert abs(1 / (1 + np.exp(-np.clip(total, -30, 30))) - score) < 1e-9


def test_machine_learns_a_product_of_features():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(600):
        a, b = rng.integers(2), rng.integers(2)
        rows.append((int(a == b), [int(a), 2 + int(b)], [1.0, 1.0]))
    machine = q.fit(rows * 6)
    right = (machine.score([r[1:] for r in rows]) > 0.5) == [r[0] for r in rows]
    assert right.mean() > 0.95


def test_words_before_n_grams():
    counts = [("aa", 0, "house", 9), ("bb", 0, "haus", 9), ("aa", 3, " th", 5), ("bb", 3, "sch", 5), ("bb", 1, "z", 2)]
    totals = {("aa", 0): 9, ("bb", 0): 9, ("aa", 3): 5, ("bb", 3): 5, ("bb", 1): 2}
    model = Model(["aa", "bb"], counts, totals)
    assert Scorer(model).predict("House")[0] == "aa" and Scorer(model).predict("schiff")[0] == "bb"
    assert Scorer(model).predict("thzz")[0] == "aa"  # the longer n-gram decides
    assert Scorer(model).predict("zzz")[0] == "bb"
    assert Scorer(model).predict("12 !")[0] == "und"


def test_sources_meet_their_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([1, 3, 20, 50, 200]), rng.choice("aaaaabc") if i % 50 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = mix(docs).collect(), mix(docs.repartition(7)).collect()
    assert sorted(first) == sorted(again)
    sizes, taken, target = Counter(), Counter(), {}
    source = {r[0]: r[2] for r in rows}
    for r in first:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["taken"] in (0, r["size"], 2 * r["size"])
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for s in sizes:
        assert target[s] <= 2 * sizes[s] and abs(taken[s] - target[s]) <= 200


def test_draws_keep_their_probability(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(4000)], "doc_id long, text string, source string")
    rows = mix(docs).collect()
    for size in range(1, 10):
        own = [r for r in rows if r["size"] == size and 0 < r["target"] / r["source_size"] % 1]
        want = own[0]["target"] / own[0]["source_size"]
        assert abs(sum(r["copies"] for r in own) / len(own) - want) < 0.12


@pytest.mark.parametrize(
    "url, rule, verdict",
    [
        ("http://a.example.net/en/x", "example.net/en/", "allow"),
        ("http://A.EXAMPLE.NET/fr/", "net/", "block"),
        ("http://example.net", None, "allow"),
        ("https://x.org/fr/casino", "org/fr/", "allow"),
        ("https://x.org/casino", None, "block"),
        ("https://x.org/casinos", None, "allow"),
        ("https://free-bets.example.com/", None, "block"),
        ("https://free-free.example.com/", None, "allow"),
        ("https://freebets.example.com/de/", "example.com/de/", "block"),
        ("no scheme casino", None, "block"),
        (None, None, "allow"),
    ],
)
def test_url_verdicts(spark, url, rule, verdict):
    row = url_filter.judge_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (row["rule"], row["verdict"]) == (rule, verdict)


def test_license_rules_need_their_order(spark):
    a, b = "The first known sentence here", "The second known one"
    rules = (("L", (a, b)), ("N", ("Notice of N, version 2.0",)))
    texts = [f"{a}.\n{b}!", f"{b}. {a}.", f"x. {a}! other words. {b}", f"{a}", "notice of N,  version 2.0. More", f"x{a}. {b}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs, rules=rules).collect()}
    assert got == {(0, "L"), (2, "L"), (4, "N")}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    out = []
    for kind in personal_data.KINDS:
        for m in re.finditer(BASE[kind], text or ""):
            figures = re.sub(r"\D", "", m[0], flags=re.A)
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(figures))]
            luhn = sum(d - 9 if d > 9 else d for d in twice) % 10 == 0
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(figures) <= 19 and luhn,
                "phone": 9 <= len(figures) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_plain_matching(spark):
    rng = random.Random(7)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713",
             "+", " ", "\n", "\U0001f600", "x_y", "0", "255", "é", "-", "+4912345678", "0000000000000", "com"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(400)] + ["1.1.1.1 " * 600, "1" * 5000, "a@" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal_data.digest(personal_data.find_personal_data(docs)).collect():
        want = _base(texts[r["doc_id"]])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        counts = Counter(k for k, _, _ in want)
        assert tuple(r[f"n_{k}"] for k in personal_data.KINDS) == tuple(counts[k] for k in personal_data.KINDS)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(filter(None, r["spans"].split(",")))


def test_contexts_discover_identifiers(spark):
    texts = [f"please call tel {'+1' * (i % 2)}{5550000000 + i * 7919} now" for i in range(40)]
    texts += [f"we sold {7770000000 + i} of them" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in personal_data.digest(personal_data.find_personal_data(docs)).collect()}
    assert all(got[i] == f"phone:16:{len(texts[i]) - 4}" for i in range(40))
    assert all(got[i] == "" for i in range(40, 80))


@pytest.fixture(scope="module")
def trees():
    noise = "<nav><ul><li><a href=x>Home page</a><li><a href=y>About us</a></ul></nav><div class=ad>Buy this now, please.</div>"
    rng, rows = random.Random(8), []
    for i in range(40):
        words = [rng.choice("some plain words that fill an article of the day".split()) for _ in range(400)]
        body = "".join(f"<p>{' '.join(words[k : k + 50]).capitalize()}.</p>" for k in range(0, 400, 50))
        html = f"<html><head><title>t</title><script>var a='</p>'</script></head><body>{noise}<article><h1>Head {i}</h1>{body}</article><footer>&copy; us</footer></body></html>"
        rows += list(html_text.examples(html))
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    return html_text.fit(x, y, np.ones(len(y)))


def test_main_text(trees):
    a, b = "Some long article text, which goes on and on. " * 8, "More of it, in another paragraph. " * 6
    html = (
        "<body><nav><a href=1>a</a></nav><main><article><h1>T &amp;amp; &eacute;</h1>"
        f"<p>{a}<p><b>{b}<br>tail</b></p><div class=comments><p>Nice one!</p></div></article></main>"
        "<div class=sidebar><p>Other things to read.</p></div><footer>&copy;</footer><script>x('<p>no</p>')</script>"
    )
    assert html_text.page_text(html, trees) == f"T &amp; é\n\n{a.strip()}\n\n{b} tail".replace("  ", " ")
    assert html_text.page_text(None, trees) == html_text.page_text("", trees) == ""
    assert html_text.page_text("<p>a<p>b", None) == "a\n\nb"
    assert html_text.page_text("<![CDATA[x]]><div" * 3, None) == ""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "text ", "<article>"]), max_size=40), st.integers(0, 99))
def test_decoding_is_consistent_and_best(parts, seed):
    page = html_text.Page("".join(parts))
    logit = np.random.default_rng(seed).normal(size=len(page.parent))
    kept = html_text.decode(page, logit, None)
    assert all(kept[p] for i, p in enumerate(page.parent) if i and kept[i])


def test_hidden_and_deep_pages(trees):
    deep = "<b>" * 3000 + "<div>" * 3000 + "word" + "</span>" * 3000
    assert html_text.page_text(deep, None) == "word"


def test_rare_marked_pages_are_found(spark):
    # 3 of 600 pages mark their article, 300 only name the tag in a comment
    words = "The long story goes on, as told by those who were there that day. "
    marked = f"<body><nav><a>Home</a></nav><article><p>{words * 3}</p><p>{words}</p></article></body>"
    rows = [
        (i, marked if i % 200 == 7 else f"<body>{'<!-- <article> -->' if i % 2 else ''}<p>menu</p></body>")
        for i in range(600)
    ]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    assert html_text.train(pages, fit_pages=2) is not None
    assert html_text.train(pages.filter("page_id % 200 <> 7"), fit_pages=2) is None
    assert html_text.train(pages.selectExpr("cast(null as long) page_id", "html"), fit_pages=2) is not None


def test_items_are_found_as_whole_words():
    matcher = Matcher([(1, "art"), (2, "a"), (3, "the art of war"), (4, "noon")], 0.0)

    def found(text):
        return {matcher.items[i][0]: normal(text)[hit[1] : hit[2]] for i, hit in matcher.search(text).items()}

    assert found("The party met at noon.") == {4: "noon"}
    assert found("Bathe art of warm a") == {1: "art", 2: "a"}
    assert found("art") == {1: "art"} and found("(The ART of war!)") == {1: "art", 3: "the art of war"}
    assert found("") == found(None) == {}


def test_contexts_discover_what_the_base_patterns_miss(spark):
    rng = random.Random(11)
    seeds = [f"please call tel +1 (415) 555-{1000 + i} today" for i in range(30)]
    seeds += [f"you can mail to user{i}@example.org if needed" for i in range(30)]
    hidden = [f"please call tel (487) 555-{7000 + i} today" for i in range(5)]
    hidden += [f"please call tel 0171 234 {5678 + i} today" for i in range(5)]
    hidden += [f"you can mail to {n}@localhost if needed" for n in ("anna", "bob7", "carl.b", "dora_x", "eve")]
    other = [f"we sold {7000 + rng.randrange(999)} of 12 345 items in 2019 for (3) days" for _ in range(30)]
    texts = seeds + hidden + other
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in personal_data.digest(personal_data.find_personal_data(docs)).collect()}
    want = {}
    for i, text in enumerate(texts):
        m = re.search(r"(?:tel|mail to) (.*?) (?:today|if)", text)
        want[i] = f"{'phone' if 'tel' in text else 'email'}:{m.start(1)}:{m.end(1)}" if m else ""
    assert got == want


def test_added_spans_keep_clear_of_many_base_matches(spark):
    text = " ".join(["tel +1 (415) 555-1000 x"] * 3000 + ["tel 0171 234 5678 x"] * 300)
    seeds = [f"tel +1 (415) 555-{1000 + i} x" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate([text, *seeds])), "doc_id long, text string")
    row = {r["doc_id"]: r for r in personal_data.find_personal_data(docs).collect()}[0]
    assert len(row["phone"]) == 3000 and len(row["added"]) == 300
    assert {text[a["start"] : a["end"]] for a in row["added"]} == {"0171 234 5678"}


def test_equal_rows_are_spread_over_chunks(spark):
    from pyspark.sql import functions as F

    from glossweave.llm import mixing

    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("five words in each row").alias("text"),
        F.when(F.col("id") % 2 == 0, F.lit("a")).otherwise(F.lit("b")).alias("source"),
    )
    numbered = mixing._numbered(rows.select("doc_id", F.lit(5).cast("long").alias("size"), "source"))
    assert numbered.count() == 6000 and numbered.distinct().count() == 6000
    plan = mix(rows)
    assert plan.columns == ["doc_id", "size", "source_size", "target", "taken", "copies"]
    first, again = (sorted(map(str, map(tuple, p.collect()))) for p in (plan, mix(rows.repartition(5))))
    assert first == again and len(first) == 6000
    for source in plan.groupBy("target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(source["taken"] - source["target"]) <= 10
