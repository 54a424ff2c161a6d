"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of its pieces' squared lengths). Pieces
go in descending length; each takes the open sequence that scores best among those where it fits under every
capacity: "norm" takes the least weighted norm of what would stay free, "dot" the largest weighted dot product of need
and free capacity. A chosen sequence is filled with pieces of that length while they fit.

How it scales: a piece's need depends on its length alone, so the choice runs over the counts of each length: at
most max_tokens numbers, however large the corpus, and sequences that are filled alike move together as ranges of
numbers. That gives the plan (length, from which rank, sequences from, pieces in each, offset) that the pieces then
look up by their rank among equals. Ranks come from counts per (length, bucket) and a numbering within a bucket, so a
length that a third of the pieces share is spread over as many buckets as there are shuffle partitions.

Defined results: null or empty text is one piece, the end id; rows that repeat an id are packed once each; lengths of
one piece lie in 1..max_tokens (others raise); empty tables give empty results; pack_pieces carries other columns along whatever their names, but
for earlier ones named sequence_id and offset, which are replaced; token_pieces and pack_documents return PIECE_SCHEMA's columns alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialize, slices
from .token_ids import library_coder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, coder: Callable = library_coder) -> DataFrame:
    """Encode every whole text, append end_id, and cut only what is longer than max_tokens. keep_ids adds the pieces' ids as little-endian uint32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = coder(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * max_tokens
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        own = ids[at : at + step]
                        rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), own)[: 5 + keep_ids])
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    schema = PIECE_SCHEMA + ", ids binary" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def plan_bins(counts: dict[int, int], capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.05, 0.05), score: str = "norm") -> np.ndarray:
    """Rows (length, first rank, pieces, first bin, pieces in each bin, offset) that place counts[length] pieces of each length."""
    cap, weight = np.array(capacity, float), np.array(weights, float)
    free = np.zeros((0, 3))  # of each range of bins that are filled alike
    first, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    bins, plan = 0, []

    def fill(length: int, need: np.ndarray, rank: int, left: int, room: np.ndarray, start: int, count: int) -> tuple[int, list]:
        """Put pieces in up to `count` bins with `room` from number `start`; how many, and the ranges that result."""
        each = int((room / need).min() + 1e-9)
        whole, rest = min(left // each, count), 0
        ranges, offset = [], int(cap[0] - room[0])
        if whole:
            plan.append((length, rank, whole * each, start, each, offset))
            ranges.append((room - each * need, start, whole))
        if whole < count and (rest := left - whole * each):
            plan.append((length, rank + whole * each, rest, start + whole, rest, offset))
            ranges.append((room - rest * need, start + whole, 1))
        if (used := whole + (rest > 0)) < count:
            ranges.append((room, start + used, count - used))
        return whole * each + rest, ranges

    for length in sorted(counts, reverse=True):
        need, left, rank = np.array([length, 1, length * length], float), counts[length], 0
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities {capacity}")
        fits = np.flatnonzero((free >= need).all(axis=1)) if len(free) else np.zeros(0, int)
        if len(fits):
            rest = (free[fits] - need) / cap
            rating = -np.sqrt((weight * rest**2).sum(axis=1)) if score == "norm" else (weight * (free[fits] / cap) * (need / cap)).sum(axis=1)
            gone, made = [], []
            for i in fits[np.lexsort((first[fits], -rating))]:
                if not left:
                    break
                put, ranges = fill(length, need, rank, left, free[i], int(first[i]), int(many[i]))
                rank, left = rank + put, left - put
                gone.append(i)
                made += ranges
            if gone:
                keep = np.setdiff1d(np.arange(len(free)), gone)
                made = [r for r in made if r[0][0] >= 1 and r[0][1] >= 1 and r[0][2] >= 1]
                free = np.vstack([free[keep], *(r[0][None] for r in made)])
                first, many = np.r_[first[keep], [r[1] for r in made]].astype(np.int64), np.r_[many[keep], [r[2] for r in made]].astype(np.int64)
        if left:
            each = int((cap / need).min() + 1e-9)
            count = -(-left // each)
            put, ranges = fill(length, need, rank, left, cap, bins, count)
            bins += count
            ranges = [r for r in ranges if r[0][0] >= 1 and r[0][1] >= 1 and r[0][2] >= 1]
            free = np.vstack([free, *(r[0][None] for r in ranges)])
            first, many = np.r_[first, [r[1] for r in ranges]].astype(np.int64), np.r_[many, [r[2] for r in ranges]].astype(np.int64)
    return np.array(plan, np.int64).reshape(-1, 6)


def pack_pieces(pieces: DataFrame, max_tokens: int = 2048, max_docs: int | None = None, max_attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), score: str = "norm", key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces (materialized, with a column length) plus sequence_id and offset. Unset capacities never bind before tokens do."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).filter("length > 0").collect()}  # a number per length
    if any(n > max_tokens for n in counts):
        raise ValueError(f"pieces hold up to {max_tokens} tokens")
    plan = plan_bins(counts, (max_tokens, max_docs or max_tokens, max_attention or float(max_tokens) ** 2), weights, score)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast(plan)  # bounded by max_tokens and the capacities, not by the corpus

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    carried = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    rows = pieces.select(F.struct(*(F.col(f"`{f.name}`") for f in carried)).alias("row"), F.col("length").cast("long").alias("length"), F.struct(*key).alias("key"), F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("bucket"))
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("within", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("key"))).join(before, ["length", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        marks = plan[:, 0] << 44 | plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (1, 2))
            row = plan[np.searchsorted(marks, length << 44 | rank, side="right") - 1]
            at = rank - row[:, 1]
            yield pa.record_batch([*batch.column(0).flatten(), pa.array(row[:, 3] + at // row[:, 4]), pa.array(row[:, 5] + at % row[:, 4] * length)], names=[*(f.name for f in carried), "sequence_id", "offset"])

    schema = StructType([*carried, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.select("row", "length", (F.col("before") + F.col("within") - 1).alias("rank")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0, **limits) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there."""
    return pack_pieces(materialize(token_pieces(docs, tokenizer, max_tokens, end_id), "pieces"), max_tokens, **limits)
