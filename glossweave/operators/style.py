"""Nearest style vectors: exact k nearest neighbours by blocks, and an LSH form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from glossweave.session import stored

# Similarities are ranked after rounding, so that copies of a vector tie exactly.
DIGITS = 6
#: Bytes of bounds that one step of a batch computes.
BOUND_BYTES = 256 << 20
SLACK = 1e-5
#: Pivots are sent to every task; beyond this number cells grow.
MOST_PIVOTS = 4096
#: Bytes of vectors that a task holds of each side; fewer, so that there are LEAST_SHARDS of a large table.
SHARD_BYTES = 32 << 20
LEAST_SHARDS = 8
#: Queries and library vectors multiplied at a time inside a task.
QUERY_STEP, LIBRARY_STEP = 1024, 4096


def _units(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Unit vectors of doubles as (_id, _u); a zero vector has no direction and is left out."""
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda a, x: a + x * x))
    return (
        df.select(F.col(id_col).alias("_id"), doubles.alias("_x"))
        .withColumn("_n", norm)
        .filter(F.col("_n") > 0)
        .select("_id", F.transform("_x", lambda x: x / F.col("_n")).alias("_u"))
    )


def _pivots(library: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` library vectors, picked by a hash of their content."""
    rows = library.select("_u").orderBy(F.xxhash64("_u")).limit(n).collect()
    return np.array([r[0] for r in rows])


def _distances(vectors: pd.Series, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (np.stack(vectors.to_numpy()) @ pivots.T)))


def _slices(frames: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Batches cut so that ``width`` doubles per row stay within BOUND_BYTES."""
    step = max(1, BOUND_BYTES // (16 * width))
    for frame in frames:
        for at in range(0, len(frame), step):
            yield frame.iloc[at : at + step]


def _in_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot as ``_cell`` and the distance to it as ``_own``."""

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _slices(frames, len(pivots)):
            d = _distances(frame["_u"], pivots)
            yield frame.assign(_cell=d.argmin(axis=1).astype("int32"), _own=d.min(axis=1))

    return df.mapInPandas(cells, f"_id {df.schema['_id'].dataType.simpleString()}, _u array<double>, _cell int, _own double")


def _shard_rows(n: int, block: int, dim: int) -> int:
    """Vectors in a shard of a table of ``n``: ``block`` at least, else by bytes and by LEAST_SHARDS."""
    return max(block, min(SHARD_BYTES // (8 * dim), -(-n // LEAST_SHARDS)))


def nearest_style(
    queries: DataFrame,
    library: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector: str = "embedding",
    n_pivots: int | None = None,
    block: int = 4096,
    exclude_self: bool = True,
) -> DataFrame:
    """Exact k nearest library vectors by cosine: (query_id, rank, match_id, similarity).

    Library vectors live in the cell of their nearest pivot, a cell for about ``block``
    vectors.  The pivots give each query an upper bound on its k-th distance and each cell a
    lower bound, so a query is sent only where a cell can hold a result (triangle inequality
    on unit vectors).  What is sent are not single cells but shards: neighbouring cells
    together, up to the bytes a task holds, and the queries that want them likewise.  Each
    pair of shards returns its k best per query, so a vector is copied once per shard of the
    other side, however small the cells are.
    """
    lib = _units(library, id_col, vector)
    if n_pivots is None:
        n_pivots = min(MOST_PIVOTS, max(1, lib.count() // block))
    pivots = _pivots(lib, n_pivots)
    if len(pivots) == 0:
        raise ValueError("the library is empty")
    lib = stored(_in_cells(lib, pivots), "library")
    need = k + 1 if exclude_self else k

    # Per cell: size, radius and the `need` smallest distances; at most n_pivots rows.
    counts = lib.groupBy("_cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("_own").alias("radius")
    ).collect()
    near = _smallest(lib.select("_cell", "_own"), need).collect()
    radius = {r["_cell"]: (r["n"], r["radius"]) for r in counts}
    inner = {c: [] for c in radius}
    for r in near:
        inner[r["_cell"]].append(r["_own"])
    # cells of one region follow each other: those nearest to the same of the first pivots
    region = (pivots @ pivots[: max(1, int(len(pivots) ** 0.5))].T).argmax(axis=1)
    cells = sorted(radius, key=lambda c: (region[c], c))
    reach = np.array([radius[c][1] for c in cells])
    flat_cell = np.array([i for i, c in enumerate(cells) for _ in inner[c]])
    flat_own = np.array([d for c in cells for d in inner[c]])
    n_lib = sum(n for n, _ in radius.values())
    full = _shard_rows(n_lib, block, pivots.shape[1])
    bins, starts, filled = {}, [], full
    for i, c in enumerate(cells):
        if filled + radius[c][0] > full:
            starts.append(i)
            filled = 0
        filled += radius[c][0]
        bins[c] = len(starts) - 1
    kth = min(need, len(flat_own)) - 1

    def wanted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _slices(frames, len(flat_own) + len(pivots)):
            d = _distances(frame["_u"], pivots)[:, cells]
            bound = np.full(len(d), np.inf)
            if len(flat_own) >= need:
                bound = np.partition(d[:, flat_cell] + flat_own, kth, axis=1)[:, kth]
            # Comparing squared distances keeps the slack in units of similarity.
            low = np.maximum(0.0, d - reach)
            mask = np.logical_or.reduceat(low**2 <= bound[:, None] ** 2 + SLACK, starts, axis=1)
            yield frame.assign(_bins=[np.flatnonzero(row).astype("int32") for row in mask])

    asking = _units(queries, id_col, vector)
    kind = asking.schema["_id"].dataType.simpleString()
    q = stored(
        asking.mapInPandas(wanted, f"_id {kind}, _u array<double>, _bins array<int>")
        .select("_id", "_u", F.explode("_bins").alias("_bin")),
        "queries",
    )
    lib = lib.withColumn("_bin", F.element_at(F.create_map(*[F.lit(x) for c in bins for x in (c, bins[c])]), F.col("_cell")))
    return _top_k(_shard_products(q, lib.select("_id", "_u", "_bin"), k, block, pivots.shape[1], exclude_self), k)


def _shard_products(
    q: DataFrame, lib: DataFrame, k: int, block: int, dim: int, exclude_self: bool, least: float = -np.inf
) -> DataFrame:
    """The k best (query_id, match_id, similarity) of every pair of shards whose bin is the same.

    Both sides are (_id, _u, _bin) and may have ``_h``, a list of hashes of which one at
    least must agree.  Similarities are above ``least``.
    """
    asked, held = ({r["_bin"]: r["count"] for r in side.groupBy("_bin").count().collect()} for side in (q, lib))
    both = sorted(set(asked) & set(held))
    if not both:
        return q.selectExpr("_id AS query_id", "_id AS match_id", "double(0) AS similarity").limit(0)
    q_full = _shard_rows(max(asked.values()), block, dim)
    l_full = _shard_rows(sum(held.values()), block, dim)
    n_qs, n_ls = (
        F.element_at(F.create_map(*[F.lit(x) for b in both for x in (b, -(-n[b] // full))]), F.col("_bin"))
        for n, full in ((asked, q_full), (held, l_full))
    )
    hashes = ["_h"] if "_h" in q.columns else []
    both_bins = F.col("_bin").isin(both)

    def spread(side: DataFrame, own: str, n_own, other: str, n_other) -> DataFrame:
        return side.filter(both_bins).select(
            "_id", "_u", *hashes, "_bin", F.pmod(F.xxhash64("_id"), n_own).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), n_other - 1)).alias(other),
        )

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "match_id": [], "similarity": []})
        if left.empty or right.empty:
            return empty.astype({"query_id": "int64", "match_id": "int64", "similarity": "float64"})
        right = right.sort_values("_id", kind="stable")
        ids, units = right["_id"].to_numpy(), np.stack(right["_u"].to_numpy())
        codes = np.stack(right["_h"].to_numpy()) if hashes else None
        parts = []
        for at in range(0, len(left), QUERY_STEP):
            some = left.iloc[at : at + QUERY_STEP]
            own = np.stack(some["_h"].to_numpy()) if hashes else None
            parts.append(_k_best(some["_id"].to_numpy(), np.stack(some["_u"].to_numpy()), own, ids, units, codes, k, exclude_self, least))
        return pd.concat(parts)

    keys = ["_bin", "_qs", "_ls"]
    return (
        spread(q, "_qs", n_qs, "_ls", n_ls).groupBy(*keys)
        .cogroup(spread(lib, "_ls", n_ls, "_qs", n_qs).groupBy(*keys))
        .applyInPandas(best, "query_id long, match_id long, similarity double")
    )


def _k_best(
    qids: np.ndarray, q_units: np.ndarray, q_codes, ids: np.ndarray, units: np.ndarray, codes, k: int, exclude_self: bool, least: float
) -> pd.DataFrame:
    """The k best of ``ids`` (ascending) for each query; of equal similarities the smaller id.

    Later ids lose ties, so of each slice only what beats a query's k-th so far is looked at.
    """
    top = np.full((len(qids), k), -np.inf)
    top_ids = np.zeros((len(qids), k), ids.dtype)
    at = 0
    while at < len(ids):
        # a short first slice gives the bounds for the others
        end = at + (LIBRARY_STEP if at else LIBRARY_STEP // 16)
        sim = q_units @ units[at:end].T
        kth = top[:, -1]
        flat = np.flatnonzero((sim > np.maximum(least, kth + 0.4 * 10.0**-DIGITS)[:, None]).ravel())
        rows, cols = np.divmod(flat, sim.shape[1])
        value = np.round(sim.ravel()[flat], DIGITS)
        keep = value > kth[rows]
        if exclude_self:
            keep &= qids[rows] != ids[at + cols]
        if codes is not None:
            keep[keep] = (q_codes[rows[keep]] == codes[at + cols[keep]]).any(axis=1)
        rows, cols, value = rows[keep], cols[keep], value[keep]
        if len(rows):
            touched = np.unique(rows)
            row = np.concatenate([np.repeat(touched, k), rows])
            all_value = np.concatenate([top[touched].ravel(), value])
            all_ids = np.concatenate([top_ids[touched].ravel(), ids[at + cols]])
            order = np.lexsort((all_ids, -all_value, row))
            row = row[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            first = order[rank < k]
            top[touched] = all_value[first].reshape(len(touched), k)
            top_ids[touched] = all_ids[first].reshape(len(touched), k)
        at = end
    found = np.isfinite(top)
    return pd.DataFrame({"query_id": np.repeat(qids, found.sum(axis=1)), "match_id": top_ids[found], "similarity": top[found]})


def _smallest(df: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("_cell").orderBy("_own")
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def _top_k(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "match_id")
    return (
        found.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "match_id", "similarity")
    )


def nearest_style_lsh(
    queries: DataFrame,
    library: DataFrame,
    k: int,
    max_distance: float,
    id_col: str = "vec_id",
    vector: str = "embedding",
    bucket: float = 2.0,
    tables: int = 4,
) -> DataFrame:
    """Approximate form with random projections; may miss matches, never invents one.

    ``max_distance`` is Euclidean on unit vectors: sqrt(2 - 2 * cosine).
    """
    q, lib = _units(queries, id_col, vector), stored(_units(library, id_col, vector), "library")
    first = lib.agg(F.count(F.lit(1)), F.max(F.size("_u"))).first()
    if not first[0]:
        raise ValueError("the library is empty")
    model = BucketedRandomProjectionLSH(
        inputCol="_v", outputCol="_hash", bucketLength=bucket, numHashTables=tables, seed=7
    ).fit(lib.select(array_to_vector("_u").alias("_v")))

    def hashed(df: DataFrame) -> DataFrame:
        values = [vector_to_array(F.col("_hash")[i])[0].cast("long") for i in range(tables)]
        return model.transform(df.withColumn("_v", array_to_vector("_u"))).select("_id", "_u", F.array(*values).alias("_h"))

    # rows of one signature share a bin; a query goes to the bins that share a hash with it
    n_bins = -(-first[0] // _shard_rows(first[0], 4096, first[1]))
    lib = stored(hashed(lib).withColumn("_bin", F.pmod(F.xxhash64("_h"), F.lit(n_bins)).cast("int")), "hashed")
    held = lib.select("_bin", F.posexplode("_h").alias("_t", "_x")).groupBy("_t", "_x").agg(F.collect_set("_bin").alias("_bins"))
    q = hashed(q).select("*", F.posexplode("_h").alias("_t", "_x")).join(held, ["_t", "_x"])
    q = stored(q.select("_id", "_u", "_h", F.explode("_bins").alias("_bin")).distinct(), "queries")
    return _top_k(_shard_products(q, lib, k, 4096, first[1], True, 1 - max_distance**2 / 2), k)
