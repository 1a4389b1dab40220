"""Exact duplicates by a cuckoo-filter index over text digests.

Texts are equal when their normalised bytes are: A-Z is lower-cased, null is the empty
text.  Each task keeps a cuckoo filter over the digests it has seen; a hit of the
filter is verified against the content stored in the same bucket, so a false positive
never merges two texts.  Tasks combine their own rows first, so a text that makes up
a third of all rows leaves each task as one row; the combined rows meet by digest in a
second such index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from glossweave.llm.common import LOWER, UPPER, drop_rows, fresh, map_rows, text_of, type_of
from glossweave.session import stored

#: Digests a task holds before it passes its combined rows on.
HELD = 200_000


class CuckooIndex:
    """A cuckoo filter whose slots also point to the stored key and its value.

    Each key has two candidate buckets of four slots.  The filter compares 16-bit
    fingerprints; only on equality is the stored key compared.  When an insertion
    finds no room after ``MAX_KICKS`` moves, the number of buckets doubles and the
    filter is built again from the stored keys.
    """

    SLOTS, MAX_KICKS = 4, 64

    def __init__(self, buckets: int = 64):
        self._clear(buckets)
        self.live = 0

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = [0] * (buckets * self.SLOTS)
        self.content: list = [None] * (buckets * self.SLOTS)

    def _place(self, key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[:8], "big") % self.buckets, int.from_bytes(key[8:10], "big") or 1

    def _other(self, bucket: int, mark: int) -> int:
        # the number of buckets is a power of two, so this is its own inverse
        return bucket ^ ((mark * 0x5BD1E995) % self.buckets)

    def _slots(self, key: bytes) -> Iterator[int]:
        """Slots whose fingerprint equals the key's: the filter's hits."""
        bucket, mark = self._place(key)
        for b in {bucket, self._other(bucket, mark)}:
            for slot in range(b * self.SLOTS, (b + 1) * self.SLOTS):
                if self.prints[slot] == mark:
                    yield slot

    def _find(self, key: bytes) -> int | None:
        return next((s for s in self._slots(key) if self.content[s][0] == key), None)

    def get(self, key: bytes):
        slot = self._find(key)
        return None if slot is None else self.content[slot][1]

    def put(self, key: bytes, value) -> None:
        """Insert the key, or replace its value."""
        slot = self._find(key)
        if slot is not None:
            self.content[slot] = (key, value)
            return
        self._insert((key, value))
        self.live += 1

    def delete(self, key: bytes) -> bool:
        slot = self._find(key)
        if slot is None:
            return False
        self.prints[slot], self.content[slot] = 0, None
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple]:
        return (x for x in self.content if x is not None)

    def _insert(self, entry: tuple) -> None:
        left = self._try(entry)
        if left is None:
            return
        everything, size = [*self.items(), left], self.buckets
        while left is not None:
            size *= 2
            self._clear(size)
            left = next((x for x in everything if self._try(x) is not None), None)

    def _try(self, entry: tuple) -> tuple | None:
        """Place the entry, moving others; what had to stay out, or None."""
        bucket, mark = self._place(entry[0])
        for b in (bucket, self._other(bucket, mark)):
            for slot in range(b * self.SLOTS, (b + 1) * self.SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.content[slot] = mark, entry
                    return None
        for kick in range(self.MAX_KICKS):
            slot = bucket * self.SLOTS + (kick + mark) % self.SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.content[slot], entry = entry, self.content[slot]
            bucket = self._other(bucket, mark)
            for free in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if not self.prints[free]:
                    self.prints[free], self.content[free] = mark, entry
                    return None
        return entry


def normal_bytes(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; ``bytes.lower`` changes nothing else."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _larger(a, b):
    return b if a is None else a if b is None else max(a, b)


def _digests(rows: Iterable[tuple]) -> Iterator[tuple]:
    for key, text in rows:
        yield key, hashlib.sha256(normal_bytes(text)).digest()


def _combine(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Combine (digest, largest id, count) rows.

    A full index is emptied between two digests, so each digest of sorted input comes
    out once, and one of unsorted input at times more than once.
    """
    index, last = CuckooIndex(), None
    for digest, key, n in rows:
        if index.live >= HELD and digest != last:
            yield from ((d, *v) for d, v in index.items())
            index = CuckooIndex()
        last = digest
        known = index.get(digest)
        index.put(digest, (key, n) if known is None else (_larger(known[0], key), known[1] + n))
    yield from ((d, *v) for d, v in index.items())


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of every row."""
    return map_rows(
        docs,
        [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")],
        f"doc_id {type_of(docs, id_col)}, digest binary",
        _digests,
    )


def duplicate_groups(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size): one row per distinct text."""
    schema = f"digest binary, keep_id {type_of(digests, 'doc_id')}, group_size long"
    ones = [F.col("digest"), F.col("doc_id"), F.lit(1).cast("long")]
    parts = map_rows(digests, ones, schema, _combine)
    met = parts.repartition("digest").sortWithinPartitions("digest")
    return map_rows(met, [F.col(c) for c in met.columns], schema, _combine)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.  A null id is smaller than any
    other.  Rows that repeat id and text are counted each and are all marked alike;
    ``keep_one`` leaves one of them.  An empty table gives no rows; other columns of
    ``docs`` are ignored.
    """
    digests = stored(digest_rows(docs, id_col, text_col), "digests")
    found = stored(duplicate_groups(digests), "groups")
    return digests.join(found, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns unchanged.

    Only ids are joined back.  If some id belongs to several rows, those rows are
    compared by their text as well.
    """
    result = stored(exact_dedup(docs, id_col, text_col), "dedup")
    kept = drop_rows(docs, result.filter(~F.col("kept")).withColumnRenamed("doc_id", id_col), id_col)
    if result.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    # an id with several rows: decide each text of it on its own, and keep one row of each
    own, key, sha = (fresh(docs, name) for name in ("digest", "key", "sha"))
    digest = F.sha2(F.translate(text_of(docs, text_col), UPPER, LOWER), 256)
    stay = result.filter("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)).distinct()
    return (
        docs.withColumn(own, digest)
        .join(stay, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(own) == F.col(sha)), "left_semi")
        .dropDuplicates([id_col, own])
        .drop(own)
    )


def update_index(index: DataFrame | None, added: DataFrame | None, removed: DataFrame | None) -> DataFrame:
    """The live (doc_id, digest) rows after deletions and insertions.

    Each argument has the columns doc_id and digest (see ``digest_rows``).  Rows are
    dealt by both columns, so copies of one text spread over all tasks.  A task first
    inserts the live rows, then deletes, then inserts: a row both removed and added is
    live, a row added twice is live once, a removal of an unknown row has no effect.
    """
    steps = [(0, index), (1, removed), (2, added)]
    signed = [
        d.select("doc_id", "digest", F.lit(s).alias("step")) for s, d in steps if d is not None
    ]
    rows = signed[0]
    for more in signed[1:]:
        rows = rows.unionByName(more)
    rows = rows.withColumn("shard", F.xxhash64("doc_id", "digest"))
    met = rows.repartition("shard").sortWithinPartitions("shard", "digest", "step")

    def apply(each: Iterable[tuple]) -> Iterator[tuple]:
        live, last = CuckooIndex(), None
        for key, digest, step, shard in each:
            if shard != last and live.live >= HELD:
                yield from (v for _, v in live.items())
                live = CuckooIndex()
            last = shard
            entry = hashlib.sha256(digest + repr(key).encode()).digest()
            if step == 1:
                live.delete(entry)
            else:
                live.put(entry, (key, digest))
        yield from (v for _, v in live.items())

    columns = [F.col(c) for c in ("doc_id", "digest", "step", "shard")]
    return map_rows(met, columns, f"doc_id {type_of(rows, 'doc_id')}, digest binary", apply)
