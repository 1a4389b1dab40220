"""Benchmark passages in documents, up to an edit budget.

Texts are compared as lower-cased words with single spaces.  An item of n characters
may differ in k = floor(rate * n) edits; one too short for an edit is found as whole words
only, so "art" is not found in "party".  Cut into k + 1 pieces, at least one piece of
it survives k edits unchanged, so the exact hits of all pieces (one Aho-Corasick pass
over the document) miss nothing.  Around each hit, Myers' bit-parallel algorithm gives
the smallest distance between the item and any stretch of the document.

The items are the query set: they go to every task in blocks of bounded size, one pass
over the documents per block.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from glossweave.llm.common import map_rows, type_of, union_all

RATE = 0.08
#: Characters of items that one pass sends to every task.
BLOCK_CHARS = 4_000_000
_GAP = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    """Lower-cased words with single spaces; null is empty."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def original_span(text: str, start: int, stop: int) -> tuple[int, int]:
    """Where the stretch start..stop of ``normal(text)`` stands in the text itself.

    Lower-casing may change the length of a text in rare scripts; positions then refer
    to the lower-cased text.
    """
    at, first, last = 0, None, 0
    for m in _WORD.finditer(text.lower()):
        size = m.end() - m.start()
        if at + size > start and first is None:
            first = m.start() + max(0, start - at)
        if at < stop:
            last = m.start() + min(size, stop - at)
        at += size + 1
        if at >= stop and first is not None:
            break
    return first or 0, last


def best_match(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the stretch of ``text`` nearest to ``pattern``, or None above the budget.

    Myers 1999 with one big integer per bit vector; ties go to the earliest end.
    """
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(pattern)) - 1
    top = 1 << (len(pattern) - 1)
    plus, minus, score = full, 0, len(pattern)
    best: tuple[int, int] | None = None
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        zero = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up = minus | (full & ~(zero | plus))
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(zero | up))
        minus = up & zero
        if score <= budget and (best is None or score < best[0]):
            best = (score, end)
    return best


class Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple], rate: float = RATE):
        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            pattern = normal(text)
            if not pattern:
                continue
            budget = int(rate * len(pattern))
            at = len(self.items)
            self.items.append((key, pattern, budget))
            cuts = [len(pattern) * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(pattern[a:b], []).append((at, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def search(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """For each item found: (distance, start, end) of its nearest stretch in the normal text.

        start is end minus the item's length: exact for distance zero, else within the
        distance of the true start.  An item without a budget is found as whole words only.
        """
        found: dict[int, tuple[int, int, int]] = {}
        if not self.items:
            return found
        norm = normal(text)
        framed = f" {norm} "
        tried: set[tuple[int, int]] = set()
        for last, (size, places) in self.automaton.iter(norm):
            for item, offset in places:
                _, pattern, budget = self.items[item]
                shift = last + 1 - size - offset
                if not budget:  # the piece is the item: a hit is exact and has to be whole words
                    end = shift + len(pattern)
                    if item not in found and framed[shift] == framed[end + 1] == " ":
                        found[item] = (0, shift, end)
                    continue
                # a window holds all alignments whose shift falls into its slot
                slot = shift // (budget + 1)
                if (item, slot) in tried:
                    continue
                tried.add((item, slot))
                low = max(0, slot * (budget + 1) - budget)
                high = (slot + 1) * (budget + 1) + len(pattern) + budget
                hit = best_match(pattern, norm[low:high], budget)
                if hit and (item not in found or (hit[0], low + hit[1]) < (found[item][0], found[item][2])):
                    end = low + hit[1]
                    found[item] = (hit[0], max(0, end - len(pattern)), end)
        return found


def item_blocks(items: DataFrame, item_id: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The items in lists of about ``block_chars`` characters; one is on the driver at a time."""
    picked = items.select(
        F.col(item_id).alias("item"), F.col(text_col).cast("string").alias("text")
    ).filter("text is not null")
    total = picked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for block in range(blocks):
        part = picked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        yield [tuple(r) for r in part.collect()]


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rate: float = RATE,
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance, budget, span_start, span_end.

    The span is in the document's text.  Null or blank texts hold nothing and null or
    blank items are found nowhere.  A repeated row of ``docs`` gives its rows again; a
    repeated item gives one row each.  No hit, or an empty table, gives no rows.
    """
    schema = (
        f"doc_id {type_of(docs, id_col)}, item_id {type_of(items, item_id)}, "
        "distance int, budget int, span_start int, span_end int"
    )
    columns = [F.col(id_col), F.col(text_col).cast("string")]
    frames = []
    for block in item_blocks(items, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def search(each: Iterable[tuple], sent=sent) -> Iterator[tuple]:
            matcher = Matcher(sent.value, rate)
            for key, text in each:
                for item, (distance, start, end) in sorted(matcher.search(text).items()):
                    yield key, matcher.items[item][0], distance, matcher.items[item][2], *original_span(text, start, end)

        frames.append(map_rows(docs, columns, schema, search))
    return union_all(frames) if frames else docs.sparkSession.createDataFrame([], schema)


def _found(docs: DataFrame, block: list[tuple], text_col: str, rate: float) -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf("boolean")
    def hit(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(sent.value, rate)
        for texts in parts:
            yield pd.Series([bool(matcher.search(t)) for t in texts], dtype=bool)

    return hit(F.col(text_col).cast("string"))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rate: float = RATE,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns unchanged and nothing shuffled."""
    for block in item_blocks(items, item_id, item_text):
        docs = docs.filter(~_found(docs, block, text_col, rate))
    return docs
