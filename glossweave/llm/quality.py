"""Document quality by a factorisation machine.

A document's features are its hashed words (log counts, unit length), structure
statistics with their bins, and its length.  The machine adds to the linear part the
products of all feature pairs, whose weights are inner products of low-rank vectors;
the identity  sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)
scores a document in time linear in its features.

Fitting uses about ``fit_rows`` labelled documents, a share of the labelled ids chosen
by hash, so its cost does not grow with the input.  Every document is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from glossweave.llm.common import map_rows, share_below

WORD_BITS = 12
RANK = 6
BINS = 10
#: Labelled documents used for fitting, at most about this many.
FIT_ROWS = 10_000
EPOCHS, BATCH_ROWS, RATE, DECAY = 8, 128, 0.01, 1e-5
THRESHOLD = 0.3

_LETTER_UP, _LETTER_LOW, _DIGIT, _BLANK, _STOP, _MARK, _HIGH = range(7)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[128:] = _HIGH
for _chars, _kind in (
    (range(65, 91), _LETTER_UP), (range(97, 123), _LETTER_LOW), (range(48, 58), _DIGIT),
    ((9, 10, 11, 12, 13, 32), _BLANK), (b".,;:'\"-", _STOP),
):
    _CLASS[list(_chars)] = _kind
_TAIL = re.compile(r"([^\w\s])\1\Z")
_STATS = 16
SIZE = (1 << WORD_BITS) + _STATS * (BINS + 1)


def _statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Structure and length, each scaled to about 0 to 1."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=7) / max(1, len(raw))
    lines = [x for x in text.split("\n") if x]
    n, most = max(1, len(words)), max(1, len(lines))
    odd = sum(c for w, c in counts.items() if _TAIL.search(w))
    alone = sum(c for w, c in counts.items() if not w[0].isalnum() and len(w) == 1)
    return [
        *(float(x) for x in kinds[[_LETTER_UP, _DIGIT, _BLANK, _STOP, _MARK, _HIGH]]),
        odd / n,
        alone / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        1 - len(set(lines)) / most if lines else 0.0,
        min(1.0, sum(map(len, counts)) / max(1, len(counts)) / 12),
        min(1.0, len(lines) / n),
        min(1.0, np.log1p(len(words)) / 10),
        min(1.0, np.log1p(len(text)) / 12),
        min(1.0, np.log1p(max(map(len, lines), default=0)) / 10),
    ]


def features(text: str | None) -> tuple[list[int], list[float]]:
    """Indices and values of a text's features; null is the empty text."""
    text = text or ""
    words = text.lower().split()
    counts = Counter(words)
    mask = (1 << WORD_BITS) - 1
    hashed: dict[int, float] = {}
    for word, n in counts.items():
        bucket = crc32(word.encode("utf-8", "surrogatepass")) & mask
        hashed[bucket] = hashed.get(bucket, 0) + n
    values = np.log1p(np.fromiter(hashed.values(), float, len(hashed)))
    norm = float(np.sqrt((values**2).sum())) or 1.0
    index, value = list(hashed), (values / norm).tolist()
    base = mask + 1
    for i, x in enumerate(_statistics(text, words, counts)):
        start = base + i * (BINS + 1)
        index += [start, start + 1 + min(BINS - 1, int(x * BINS))]
        value += [x, 1.0]
    return index, value


class Machine:
    """Weights of a factorisation machine over ``SIZE`` features."""

    def __init__(self, bias: float = 0.0, linear=None, factors=None):
        self.bias = bias
        self.linear = np.zeros(SIZE) if linear is None else linear
        self.factors = np.zeros((SIZE, RANK)) if factors is None else factors

    def parts(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray):
        """Scores before the logistic function, and the sums over i of v_if x_i."""
        weighted = self.factors[index] * value[:, None]
        sums = np.add.reduceat(weighted, starts)
        squares = np.add.reduceat((weighted**2).sum(1), starts)
        linear = np.add.reduceat(self.linear[index] * value, starts)
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums

    def score(self, rows: Sequence[tuple[list[int], list[float]]]) -> np.ndarray:
        raw, _ = self.parts(*_flat(rows))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _flat(rows):
    sizes = np.array([len(i) for i, _ in rows])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    index = np.concatenate([np.asarray(i, np.int64) for i, _ in rows])
    return index, np.concatenate([np.asarray(v, float) for _, v in rows]), starts


def fit(rows: Sequence[tuple[int, list[int], list[float]]]) -> Machine:
    """Log loss by Adam over shuffled batches; the same rows in the same order give the same weights."""
    rng = np.random.default_rng(7)
    labels = np.array([r[0] for r in rows], float)
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    machine = Machine(float(np.log(share / (1 - share))), None, rng.normal(0, 0.01, (SIZE, RANK)))
    state = [np.zeros((SIZE, RANK + 1)) for _ in range(2)]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH_ROWS):
            picked = order[at : at + BATCH_ROWS]
            index, value, starts = _flat([rows[i][1:] for i in picked])
            raw, sums = machine.parts(index, value, starts)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[picked]) / len(picked)
            owner = np.repeat(np.arange(len(picked)), np.diff([*starts, len(index)]))
            slope = error[owner] * value
            grads = np.empty((SIZE, RANK + 1))
            grads[:, 0] = np.bincount(index, slope, SIZE)
            own = machine.factors[index] * value[:, None]
            for f in range(RANK):
                grads[:, f + 1] = np.bincount(index, slope * (sums[owner, f] - own[:, f]), SIZE)
            weights = np.column_stack([machine.linear, machine.factors])
            grads += DECAY * weights
            step += 1
            state[0] += 0.1 * (grads - state[0])
            state[1] += 0.01 * (grads**2 - state[1])
            move = state[0] / (1 - 0.9**step) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
            weights -= RATE * move
            machine.linear, machine.factors = weights[:, 0].copy(), weights[:, 1:].copy()
            machine.bias -= RATE * float(error.sum())
    return machine


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fit_rows: int = FIT_ROWS,
) -> Machine:
    """Fit on documents with a 0/1 label; other labels and null ids are left out.

    About ``fit_rows`` labelled ids are drawn by hash, so the table of drawn labels may
    be broadcast and one task can hold their features.  Without any label the machine
    scores 0.5 everywhere.
    """
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    n = marked.count()
    if not n:
        return Machine()
    drawn = (
        marked.filter(share_below(F.col(id_col).cast("string"), min(1.0, fit_rows / n)))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("label"))
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(drawn), "_id")

    def describe(each: Iterable[tuple]) -> Iterator[tuple]:
        for key, label, text in each:
            yield str(key), label, *features(text)

    rows = map_rows(
        joined,
        [F.col("_id"), F.col("label"), F.col("text")],
        "key string, label int, i array<int>, x array<double>",
        describe,
    )

    def learn(each: Iterable[tuple]) -> Iterator[tuple]:
        got = sorted(each)
        if got:
            machine = fit([r[1:] for r in got])
            yield -1, machine.bias, []
            for i in np.nonzero(np.abs(machine.factors).sum(1) + np.abs(machine.linear))[0]:
                yield int(i), float(machine.linear[i]), machine.factors[i].tolist()

    weights = map_rows(
        rows.repartition(1),
        [F.col(c) for c in rows.columns],
        "feature int, linear double, factors array<double>",
        learn,
    ).collect()
    machine = Machine()
    for feature, linear, factors in weights:
        if feature < 0:
            machine.bias = linear
        else:
            machine.linear[feature], machine.factors[feature] = linear, factors
    return machine


def score_column(docs: DataFrame, machine: Machine, text_col: str = "text") -> Column:
    """The score of each text, 0 to 1; the model is a few thousand numbers, so it is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(
        (machine.bias, machine.linear.astype("float32"), machine.factors.astype("float32"))
    )

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model, out = Machine(*sent.value), []
        for at in range(0, len(texts), 64):
            out.append(model.score([features(t) for t in texts.iloc[at : at + 64]]))
        return pd.Series(np.concatenate(out).astype(float) if out else [], dtype=float)

    return score(F.col(text_col).cast("string"))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    learn_from: Column | None = None,
) -> DataFrame:
    """One row per input row: doc_id, score, predicted (1 from ``THRESHOLD`` on).

    ``learn_from`` is a condition on the labels' rows.  Null and empty texts get the
    score of an empty text, repeated rows the same score each; an empty table gives no
    rows, and other columns are ignored.
    """
    machine = train(docs, labels if learn_from is None else labels.filter(learn_from), id_col, text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), score_column(docs, machine, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", learn_from: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that are predicted good, all columns unchanged; no shuffle of texts."""
    machine = train(docs, labels if learn_from is None else labels.filter(learn_from), "doc_id", text_col)
    return docs.filter(score_column(docs, machine, text_col) >= THRESHOLD)
