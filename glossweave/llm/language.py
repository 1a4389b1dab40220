"""Language identification by known words, then by ever shorter character n-grams.

A word the model knows is scored by its log frequency in each language.  An unknown
word is scored by its character n-grams: those of the longest order of which any is
known, by their mean log frequency.  A text's language is the one with the highest sum.

Fitting uses about ``fit_docs`` documents a language, drawn by hash, and keeps the
``entries`` most frequent words and n-grams, so the model's size does not grow with
the input.  Every text is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from glossweave.llm.common import map_rows, type_of
from glossweave.session import stored

#: Documents of each language used for fitting, at most about this many.
FIT_DOCS = 2_500
#: Words and n-grams kept over all languages, at most about this many.
ENTRIES = 150_000
#: Orders of n-grams, longest first; order 0 stands for whole words.
ORDERS = (5, 4, 3, 2, 1)
SMOOTHING = 0.3
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_FLUSH = 50_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(word: str, order: int) -> Iterator[str]:
    """Character n-grams of the word with a blank at either end; single letters without blanks."""
    framed = f" {word} " if order > 1 else word
    return (framed[i : i + order] for i in range(len(framed) - order + 1))


def _count(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Summed counts (lang, kind, token, n) of a task, passed on before they grow large.

    Words are counted first, so that the n-grams of each are formed once.
    """
    words: dict[str, Counter] = {}
    held = 0
    for lang, text in rows:
        own = words.setdefault(lang, Counter())
        held -= len(own)
        own.update(words_of(text))
        held += len(own)
        if held > _FLUSH:
            yield from _with_grams(words)
            words, held = {}, 0
    yield from _with_grams(words)


def _with_grams(words: dict[str, Counter]) -> Iterator[tuple]:
    for lang, counts in words.items():
        yield from ((lang, 0, word, n) for word, n in counts.items())
        for order in ORDERS:
            found: Counter = Counter()
            for word, n in counts.items():
                for gram in grams(word, order):
                    found[gram] += n
            yield from ((lang, order, gram, n) for gram, n in found.items())


class Model:
    """Log frequencies per language: one row of ``table`` for each known word or n-gram."""

    def __init__(self, langs: list[str], counts: list[tuple], totals: dict[tuple, int]):
        self.langs = langs
        at = {lang: i for i, lang in enumerate(langs)}
        self.rows: list[dict[str, int]] = [{} for _ in range(max(ORDERS) + 1)]
        size = 0
        for _, kind, token, _ in counts:
            size += self.rows[kind].setdefault(token, size) == size
        raw = np.zeros((size, len(langs)))
        kinds = np.zeros(size, int)
        for lang, kind, token, n in counts:
            row = self.rows[kind][token]
            raw[row, at[lang]] = n
            kinds[row] = kind
        whole = np.array([[totals.get((lang, k), 0) for lang in langs] for k in range(max(ORDERS) + 1)])
        known = np.bincount(kinds, minlength=max(ORDERS) + 1)
        self.table = np.log((raw + SMOOTHING) / (whole[kinds] + SMOOTHING * (1 + known[kinds])[:, None]))

    def vector(self, word: str) -> np.ndarray:
        """Log frequency of a word in each language, or of its n-grams if it is unknown."""
        row = self.rows[0].get(word)
        if row is not None:
            return self.table[row]
        for order in ORDERS:
            known = self.rows[order]
            found = [known[g] for g in grams(word, order) if g in known]
            if found:
                return self.table[found].sum(0) / len(found)
        return np.zeros(len(self.langs))


class Scorer:
    """Scores texts; vectors of words seen before are kept in a table of bounded size."""

    def __init__(self, model: Model):
        self.model = model
        self.room = max(1024, (1 << 21) // max(1, len(model.langs)))
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.vectors = np.zeros((1024, len(self.model.langs)))

    def _row(self, word: str) -> int:
        row = self.seen.get(word)
        if row is None:
            row = self.seen[word] = len(self.seen)
            if row == len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            self.vectors[row] = self.model.vector(word)
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(words_of(text))
        if not self.model.langs or not any(any(map(str.isalpha, w)) for w in words):
            return UNKNOWN, 0.0
        if len(self.seen) > self.room:
            self._forget()
        rows = [self._row(w) for w in words]
        times = np.fromiter(words.values(), float, len(words))
        total = times @ self.vectors[rows] / np.sqrt(times.sum())
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.model.langs[best], round(float(odds[best] / odds.sum()), 6)


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fit_docs: int = FIT_DOCS,
    entries: int = ENTRIES,
) -> Model:
    """Learn from rows with a language; ties in frequency go to the token that sorts first.

    Only the number of rows per language, the kept tokens' counts and the totals come
    to the driver.
    """
    given = docs.filter(F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in given.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not sizes:
        return Model([], [], {})
    shares = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, fit_docs / n))])
    draw = F.pmod(F.xxhash64(F.lit("share"), F.col(id_col).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    drawn = given.filter(draw <= shares[F.col(lang_col).cast("string")])
    counts = stored(
        map_rows(
            drawn,
            [F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")],
            "lang string, kind int, token string, n long",
            _count,
        )
        .groupBy("lang", "kind", "token")
        .agg(F.sum("n").alias("n")),
        "counts",
    )
    each = max(1, entries // (len(sizes) * (len(ORDERS) + 1)))
    rank = Window.partitionBy("lang", "kind").orderBy(F.col("n").desc(), "token")
    top = counts.withColumn("at", F.row_number().over(rank)).filter(F.col("at") <= each)
    kept = counts.join(top.select("kind", "token").distinct(), ["kind", "token"], "left_semi")
    rows = [tuple(r) for r in kept.select("lang", "kind", "token", "n").collect()]
    sums = counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()
    totals = {(r["lang"], r["kind"]): r["n"] for r in sums}
    return Model(sorted(sizes), rows, totals)


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0, as is every text if
    nothing could be learnt.  Ties go to the language that sorts first.  Repeated rows
    get the same answer each, an empty table gives no rows, other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(each: Iterable[tuple]) -> Iterator[tuple]:
        # a worker that runs several tasks keeps the words it has seen with the model
        scorer = sent.value.scorer = getattr(sent.value, "scorer", None) or Scorer(sent.value)
        for key, text in each:
            yield key, *scorer.predict(text)

    return map_rows(
        docs,
        [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")],
        f"doc_id {type_of(docs, id_col)}, lang_pred string, score double",
        rows,
    )
