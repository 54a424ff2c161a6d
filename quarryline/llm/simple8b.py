"""Token ids as Simple-8b words in files, in ascending order of documents.

Layout: a folder of Parquet files, one row to a block of whole documents. A row holds `part` (the rank of its file in
id order), `id_offset` (ids before the block within the file), `word_offset` (words before it), the documents' ids and
lengths, and `words`: 64-bit little-endian words. The top four bits of a word select how many ids it packs and how
wide they are; ids of over 60 bits follow an escape selector as one raw word. As each block has its own offsets and
starts on a word, blocks decode independently and in vectors.

Documents are dealt by ranges of doc_id and sorted within, encoded once, and written by Spark's own committer, so a
lost executor costs only its tasks. Ids before a file are a running sum over one small row per file.

Defined results: null or empty text holds the end id alone; rows that repeat an id keep one entry each, ordered by
text; null doc_ids come first, all in one range, which one task writes; an empty table gives files without rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, slices
from .token_ids import library_coder

# Fixed values: (ids in a word, bits of each), by selector; selectors 0 and 1 stand for runs of zeros.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
#: One more than the widest selector an id doesn't fit, by id; those beyond the table's end are as wide as its last up to 20 bits.
NARROW = np.zeros(1 << 16, np.uint8)
for _bits in sorted({b for _, b in SELECTORS if b < 16}):
    NARROW[1 << _bits :] = _bits + 1
#: A word of selector 1 with this payload says that the next word is one raw id.
ESCAPE = 1 << 59
#: Ids after which a block ends, at the end of a document.
BLOCK_IDS = 65_536

BLOCK_SCHEMA = "part int, block int, id_offset long, word_offset long, doc_ids array<long>, lengths array<long>, words binary"


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned ids; each word takes the most ids that fit in it."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    width, most = NARROW[np.minimum(ids, len(NARROW) - 1)], int(ids.max())
    for bits in (20, 30, 60):
        if most >> bits:
            width[ids >= np.uint64(1 << bits)] = bits + 1
    best = np.full(n, 16, np.uint8)  # the escape, unless a selector fits
    reach, have = width.copy(), 1
    for code in range(15, 1, -1):
        count, bits = SELECTORS[code]
        while have < count and have < n:
            np.maximum(reach[: n - have], width[have:], out=reach[: n - have])
            have += 1
        if count > n:
            break
        fits = np.flatnonzero(reach[: n - count + 1] <= bits)
        if not len(fits):  # then no longer run of narrower ids fits either
            break
        best[fits] = code
    zero = np.flatnonzero(np.diff(np.r_[0, (ids == 0).view(np.int8), 0]))
    for lo, hi in zip(zero[::2], zero[1::2], strict=True):
        if hi - lo >= 120:
            best[lo : hi - 119] = 1
        if hi - lo >= 240:
            best[lo : hi - 239] = 0
    steps = np.array([*(c for c, _ in SELECTORS), 1], np.uint8)[best].tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    at = np.array(starts)
    code = best[at]
    words = code.astype(np.uint64) << np.uint64(60)
    for c in range(2, 16):
        count, bits = SELECTORS[c]
        here = np.flatnonzero(code == c)
        for k in range(count):
            words[here] |= ids[at[here] + k] << np.uint64(k * bits)
    raw = np.flatnonzero(code == 16)
    if len(raw):
        words[raw] = np.uint64(1 << 60 | ESCAPE)
        words = np.insert(words, raw + 1, ids[at[raw]])
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of packed words."""
    words = np.ascontiguousarray(words, np.uint64)
    code = (words >> np.uint64(60)).astype(np.int64)
    escape = np.uint64(1 << 60 | ESCAPE)
    if (words == escape).any():  # a raw word may look like an escape itself, so these are found in order
        raw, after = np.zeros(len(words), bool), -1
        for i in np.flatnonzero(words == escape):
            if i != after:
                raw[i], after = True, i + 1
        code[np.flatnonzero(raw) + 1] = 16
        code[raw] = 17
    counts = np.array([*(c for c, _ in SELECTORS), 1, 0])[code]
    starts = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), np.uint64)
    for c in range(2, 16):
        count, bits = SELECTORS[c]
        here = np.flatnonzero(code == c)
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            ids[starts[here] + k] = words[here] >> np.uint64(k * bits) & mask
    ids[starts[code == 16]] = words[code == 16]
    return ids


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", coder: Callable = library_coder) -> None:
    """Encode every whole text, append end_id to each, and write the files at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = coder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, held, size = [], [], 0
        block = id_offset = word_offset = 0

        def out() -> pa.RecordBatch:
            nonlocal doc_ids, held, size, block, id_offset, word_offset
            words = pack(np.frombuffer(b"".join(held), "<u4"))
            row = [part, block, id_offset, word_offset, doc_ids, [len(x) // 4 for x in held], words.astype("<u8").tobytes()]
            block, id_offset, word_offset = block + 1, id_offset + size, word_offset + len(words)
            doc_ids, held, size = [], [], 0
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for piece in slices(batch, 1):
                for doc_id, ids in zip(piece.column(0).to_pylist(), encode(piece.column(1)), strict=True):
                    doc_ids.append(doc_id)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= BLOCK_IDS:
                        yield out()
        if doc_ids:
            yield out()

    names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) from the files at path, ids as little-endian uint32 bytes; start counts all ids of the documents before."""
    return _decoded(spark, path, "doc_id long, start long, ids binary", lambda doc, start, ids: (doc, start, ids.tobytes()))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files at path."""
    return _decoded(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda doc, start, ids: (doc, start, len(ids), zlib.crc32(ids.tobytes())))


def _decoded(spark: SparkSession, path: str, schema: str, row: Callable) -> DataFrame:
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    before = materialize(before, "bases")  # a small row for each file: Spark broadcasts it as long as its size allows, and the blocks stay where they are

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_coder.cache_clear()  # a worker that has written before needs its memo no more
        arrow = [pa.int64() if f.split()[1] == "long" else pa.binary() for f in schema.split(", ")]
        for batch in batches:
            for base, offset, doc_ids, lengths, words in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids = unpack(np.frombuffer(words, "<u8")).astype("<u4")
                ends = np.cumsum(lengths).tolist()
                rows = [row(d, base + offset + e - n, ids[e - n : e]) for d, n, e in zip(doc_ids, lengths, ends, strict=True)]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    rows = blocks.join(before, "part").select("base", "id_offset", "doc_ids", "lengths", "words")
    return rows.mapInArrow(run, schema)
