"""Fill in the middle: the learned index is exact, and every output gives its text back."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from glossweave.llm import fill_middle as fm


def cut_by_hand(key, text):
    draws = [int(hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or draws[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@given(st.lists(st.integers(1, 90), max_size=400), st.integers(1, 100))
@settings(max_examples=60, deadline=None)
def test_every_boundary_is_exact_and_within_the_bound(steps, error):
    offsets = np.concatenate([[0], np.cumsum(steps)]).astype(np.int64)
    index = fm.RankIndex(offsets, error)
    assert [index.offset(i) for i in range(len(offsets))] == offsets.tolist()
    assert np.abs(index.rest).max() <= error


def test_segments_are_few_where_units_are_even():
    text = ("plain ascii " * 500 + "é" * 3000 + "中文" * 2000).encode()
    offsets = fm.code_point_boundaries(text)
    index = fm.RankIndex(offsets)
    assert len(index.first) <= 6 and index.n == len(text.decode())
    rng = random.Random(1)
    for rank in (0, index.n, *rng.sample(range(index.n), 200)):
        assert index.offset(rank) == offsets[rank]


@given(st.integers() | st.none(), st.text(alphabet="ab<>PSM é中\U0001f600\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_transform_equals_slicing_and_restores(key, text):
    got = fm.transform(key, text.encode())
    n, form, before, middle, output = cut_by_hand(key, text)
    assert got == (n, form, before, middle, output.encode())
    assert fm.restore(got[4], got[1]).decode() == text


def test_units_by_pattern_cut_between_words():
    text = "  one two  three"
    boundaries = fm.pattern_boundaries(r"\S+\s*")
    assert boundaries(text.encode()).tolist() == [0, 2, 6, 11, 16]
    for key in range(40):
        n, form, before, middle, output = fm.transform(key, text.encode(), boundaries)
        assert n == 4 and fm.restore(output, form).decode() == text
        if form == "psm":
            assert output[3:].split(b"<S>")[0] in (b"", b"  ", b"  one ", b"  one two  ", text.encode())


ROWS = [
    (1, "A plain text."), (2, None), (3, ""), (4, "has <P> inside"), (5, "é" * 5000 + "x" * 60_000), (6, " \n"),
    (7, "same"), (7, "same"), (None, "no id"), (8, "\U0001f600 café 中文 <S"),
]


@pytest.fixture()
def docs(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame(ROWS, "doc_id long, text string")
    return table.withColumns({c: F.lit("clash") for c in ("n", "form", "output", "units", "lang")})


def test_rows_equal_brute_force(docs):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for key, text in ROWS:
        n, form, before, middle, output = cut_by_hand(key, text or "")
        want.append((key, n, form, before, middle, sha(output), sha(text or "")))
    assert sorted(map(str, map(tuple, fm.fill_in_middle_digest(docs).collect()))) == sorted(map(str, want))
    whole = {r["doc_id"]: r["output"] for r in fm.fill_in_middle(docs).collect()}
    assert whole == {key: cut_by_hand(key, text or "")[4] for key, text in ROWS}


def test_empty_table(docs):
    assert fm.fill_in_middle_digest(docs.filter("1 = 0")).collect() == []
