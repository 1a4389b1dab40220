"""Fill-in-the-middle transformation with a learned index of boundary offsets.

A text is a row of units, by default its code points.  The rank index of a text maps
the number of a boundary (0 before the first unit, n after the last) to its byte offset.
It is learnt per text: straight segments follow the offsets within an error bound, and
the difference of every boundary to its segment is stored as one byte.  A cut asks the
segment for a prediction and adds the stored difference, so it is exact, and the text is
cut in its UTF-8 bytes without counting units again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from glossweave.llm.common import map_rows, type_of

#: Bytes a segment may be off; the stored differences fit into one signed byte.
MAX_ERROR = 100
#: Boundaries looked at together while a segment grows.
GROWTH = 2048
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

Boundaries = Callable[[bytes], np.ndarray]


def code_point_boundaries(data: bytes) -> np.ndarray:
    """Byte offsets of all code points, and of the end."""
    starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return np.append(starts, len(data))


def pattern_boundaries(pattern: str) -> Boundaries:
    """Units are matches of ``pattern``, left to right; what lies between joins the unit before."""
    units = regex.compile(pattern.encode())

    def boundaries(data: bytes) -> np.ndarray:
        starts = [m.start() for m in units.finditer(data) if m.end() > m.start()]
        if data and (not starts or starts[0] > 0):
            starts.insert(0, 0)
        return np.array([*starts, len(data)], np.int64)

    return boundaries


class RankIndex:
    """Segments (first rank, its offset, slope) and one stored difference per rank.

    Segments are fitted greedily: from the first boundary of a segment, the cone of
    slopes that keep all boundaries so far within the error bound narrows with each
    boundary; where it becomes empty the next segment starts.
    """

    def __init__(self, offsets: np.ndarray, error: int = MAX_ERROR):
        offsets = np.asarray(offsets, np.int64)
        self.n = len(offsets) - 1
        first, base, slope = [], [], []
        at = 0
        while at <= self.n:
            end, s = self._grow(offsets, at, error)
            first.append(at)
            base.append(int(offsets[at]))
            slope.append(s)
            at = end
        self.first, self.base = np.array(first), np.array(base)
        self.slope = np.array(slope)
        self.rest = (offsets - self._predict(np.arange(self.n + 1))).astype(np.int8)

    @staticmethod
    def _grow(offsets: np.ndarray, at: int, error: int) -> tuple[int, float]:
        """Where the segment that starts at ``at`` ends, and its slope."""
        low, high, end, step = -np.inf, np.inf, at + 1, 64
        while end < len(offsets):
            block = offsets[end : end + step]
            run = np.arange(end - at, end - at + len(block), dtype=np.float64)
            rise = block - offsets[at]
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            bad = lows > highs
            stop = int(np.argmax(bad)) if bad.any() else len(block)
            if stop:
                low, high = float(lows[stop - 1]), float(highs[stop - 1])
            end += stop
            if stop < len(block):
                break
            step = min(2 * step, GROWTH)
        return end, 0.0 if end == at + 1 else (low + high) / 2

    def _predict(self, ranks: np.ndarray) -> np.ndarray:
        own = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[own] + np.rint(self.slope[own] * (ranks - self.first[own])).astype(np.int64)

    def offset(self, rank: int) -> int:
        """The exact byte offset of a boundary."""
        return int(self._predict(np.array([rank]))[0]) + int(self.rest[rank])


def draws(key) -> list[int]:
    """Four numbers drawn from a document's id; a null id counts as empty text."""
    digest = hashlib.sha256(b"1:" + (b"" if key is None else str(key).encode())).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(key, data: bytes, boundaries: Boundaries = code_point_boundaries) -> tuple:
    """(units, form, units of the prefix, units of the middle, output) of one text."""
    offsets = boundaries(data)
    n = len(offsets) - 1
    h1, h2, h3, h4 = draws(key)
    if not data or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 90:
        return n, "plain", None, None, data
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    index = RankIndex(offsets)
    a, b = index.offset(one), index.offset(two)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < 20:
        return n, "spm", one, two - one, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", one, two - one, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def restore(output: bytes, form: str) -> bytes:
    """The text an output was made from; the text itself holds none of the marks."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    left, right = head.split(SUFFIX if form == "psm" else PREFIX)
    prefix, suffix = (left[len(PREFIX) :], right) if form == "psm" else (right, left[len(SUFFIX) :])
    return prefix + middle + suffix


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str | None = None
) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_units, middle_units, output.

    ``unit`` is a pattern of units, without it units are code points.  Cuts and form are
    drawn from the id, so repeated rows are treated alike and reruns agree.  A null text
    counts as empty and stays plain, as does a text that holds a mark; a null id draws
    like an empty one.  Texts are cut whole, whatever their length: a task holds one text
    and nine bytes for each of its units at a time.  An empty table gives no rows; other
    columns are ignored.
    """
    boundaries = code_point_boundaries if unit is None else pattern_boundaries(unit)

    def rows(each: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in each:
            n, form, before, middle, output = transform(key, _bytes(text), boundaries)
            yield key, n, form, before, middle, output.decode("utf-8", "surrogatepass")

    return map_rows(
        docs,
        _columns(id_col, text_col),
        f"doc_id {type_of(docs, id_col)}, n long, form string, prefix_units long, middle_units long, output string",
        rows,
    )


def fill_in_middle_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of ``fill_in_middle`` over code points, and of the texts restored from its outputs.

    Columns: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.
    Nulls, marks, repeated rows and empty tables are treated as there.
    """

    def rows(each: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in each:
            n, form, before, middle, output = transform(key, _bytes(text))
            yield key, n, form, before, middle, _sha(output), _sha(restore(output, form))

    return map_rows(
        docs,
        _columns(id_col, text_col),
        f"doc_id {type_of(docs, id_col)}, n long, form string, prefix_chars long, middle_chars long, "
        "output_sha256 string, restored_sha256 string",
        rows,
    )


def _columns(id_col: str, text_col: str) -> list:
    return [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
