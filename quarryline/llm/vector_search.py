"""Exact top-k by inner product: columnar branch-and-bound over blocks of dimensions.

Vectors lie vertically, one row to a dimension. For a block of queries against a block of candidates, partial products
grow by one block of dimensions at a time. What the remaining dimensions can still add is at most the product of the
two remaining norms, so each pair has a lower and an upper bound; pairs whose upper bound is under the query's k-th best
lower bound leave, candidates that no query needs are compacted away, and once few pairs are left they go on as a list.

How it scales: candidates are packed into blocks of BLOCK_BYTES where they are read, and each block moves once, to one of the slots of
its length. Query blocks of QUERY_BLOCK move to every slot: they are the smaller side, so what is shuffled is queries times blocks of candidates, and
a task holds the few blocks of one slot and one query block at a time. A slot returns k rows a query at most, which meet in one window
per query. The products themselves grow with queries times candidates, as the search is exact.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; a query meets the vectors of its own
length, as no product with others exists; ties go to the smaller id; repeated ids are separate candidates, but no query meets a row of
its own id; no queries or no candidates give an empty result; other columns are ignored. Products must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of vectors in a block of candidates, candidates in it at most, blocks to a slot, queries in a block, dimensions added at once.
BLOCK_BYTES, BLOCK, SLOT, QUERY_BLOCK, DIMS = 8 << 20, 8192, 1, 512, 16
#: Pairs go on as a list once fewer than this share of the matrix is left.
SPARSE = 0.1

BLOCK_SCHEMA = "length int, ids binary, vectors binary"


def usable(vector: Column) -> Column:
    """Not null, not empty, and all components finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(good, F.lit(False))


def blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    """Rows of (id, vector of doubles) packed vertically where they lie, vectors of one length and at most `most` of them, or BLOCK_BYTES, to a block; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(length: int) -> Iterator[pa.RecordBatch]:
            ids, flat = (np.concatenate(x) for x in zip(*held.pop(length), strict=True))
            step = max(1, min(most, BLOCK_BYTES // (8 * length)))
            for at in range(0, len(ids), step):
                own = np.ascontiguousarray(flat[at : at + step].T)
                yield pa.record_batch([pa.array([length], pa.int32()), pa.array([ids[at : at + step].tobytes()]), pa.array([own.tobytes()])], names=["length", "ids", "vectors"])

        for batch in batches:
            ids, lengths = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
            flat, starts = batch.column(1).flatten().to_numpy(), np.cumsum(lengths) - lengths
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                held.setdefault(length, []).append((ids[own], flat[(starts[own][:, None] + np.arange(length)).ravel()].reshape(-1, length)))
                if sum(len(x) for x, _ in held[length]) >= max(1, min(most, BLOCK_BYTES // (8 * length))):
                    yield from out(length)
        for length in list(held):
            yield from out(length)

    return materialize(rows.mapInArrow(run, BLOCK_SCHEMA), name)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, score) of the k best of one block for each query; arrays are dimensions x vectors of whole numbers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * len(rows)
    if most >= 2.0**53:  # beyond exact doubles
        score = queries.astype(object).T.dot(rows.astype(object)) if most >= 2.0**63 else queries.astype(np.int64).T @ rows.astype(np.int64)
        if most >= 2.0**63 and any(abs(x) >= 2**63 for x in score.flat):
            raise OverflowError("an inner product exceeds a long")
        q, c = np.nonzero(query_ids[:, None] != row_ids[None, :])
        return _first(q, c, score[q, c].astype(np.int64), row_ids, k)

    cuts = list(range(0, len(rows), DIMS))
    norms = lambda m: [np.sqrt(np.square(m[at:]).sum(axis=0)) for at in [*cuts[1:], len(m)]]
    query_rest, row_rest = norms(queries), norms(rows)
    alive = query_ids[:, None] != row_ids[None, :]
    kept = np.arange(rows.shape[1])
    partial = np.zeros(alive.shape)
    pairs = None
    for step, at in enumerate(cuts):
        if pairs is None:
            partial += queries[at : at + DIMS].T @ rows[at : at + DIMS][:, kept]
            rest = query_rest[step][:, None] * row_rest[step][kept][None, :] * (1 + 1e-9) + 1e-6
            low = np.where(alive, partial - rest, -np.inf)
            if low.shape[1] > k:
                alive &= partial + rest >= np.partition(low, -k, axis=1)[:, -k, None]
            if alive.sum() < SPARSE * alive.size:
                q, c = np.nonzero(alive)
                pairs, partial = (q, kept[c]), partial[q, c]
            elif (needed := alive.any(axis=0)).sum() < 0.9 * len(kept):
                kept, alive, partial = kept[needed], alive[:, needed], partial[:, needed]
        else:
            q, c = pairs
            partial = partial + np.einsum("dp,dp->p", queries[at : at + DIMS][:, q], rows[at : at + DIMS][:, c])
            rest = query_rest[step][q] * row_rest[step][c] * (1 + 1e-9) + 1e-6
            order = np.lexsort((-(partial - rest), q))
            rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
            bar = np.full(queries.shape[1], -np.inf)
            bar[q[order][rank == k - 1]] = (partial - rest)[order][rank == k - 1]
            stay = partial + rest >= bar[q]
            pairs, partial = (q[stay], c[stay]), partial[stay]
    if pairs is None:
        q, c = np.nonzero(alive)
        pairs, partial = (q, kept[c]), partial[q, c]
    return _first(*pairs, np.rint(partial).astype(np.int64), row_ids, k)


def _first(q: np.ndarray, c: np.ndarray, score: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((row_ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], c[rank < k], score[rank < k]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of the largest inner product. Components are whole numbers as doubles."""
    shape = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows, asked = blocks(shape(candidates), BLOCK, "candidates"), blocks(shape(queries), QUERY_BLOCK, "queries")
    slots = rows.groupBy("length").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("slots"))  # a row for each length
    own = rows.join(slots, "length").select("length", F.pmod(F.xxhash64("ids"), F.col("slots")).cast("int").alias("slot"), F.lit(0).alias("asks"), "ids", "vectors")
    to = asked.join(slots, "length").select("length", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(1).alias("asks"), "ids", "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                length, slot, asks = (batch.column(j)[i].as_py() for j in range(3))
                ids, flat = (np.frombuffer(batch.column(j)[i].as_buffer(), t) for j, t in ((3, np.int64), (4, np.float64)))
                if (length, slot) != at:
                    at, held = (length, slot), []
                if not asks:
                    held.append((ids.copy(), flat.reshape(length, -1).copy()))
                    continue
                found = [best(flat.reshape(length, -1), ids, own, own_ids, k) for own_ids, own in held]
                q, c, score = (np.concatenate(x) for x in zip(*((q, own_ids[c], s) for (q, c, s), (own_ids, _) in zip(found, held, strict=True)), strict=True)) if held else [np.zeros(0, np.int64)] * 3
                first = _first(q, np.arange(len(c)), score, c, k)
                yield pa.record_batch([pa.array(ids[first[0]]), pa.array(c[first[1]]), pa.array(first[2])], names=["query_id", "vec_id", "score"])

    dealt = own.unionByName(to).repartition("length", "slot").sortWithinPartitions("length", "slot", "asks")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
