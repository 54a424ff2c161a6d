"""SimHash near-duplicate groups by bit-sliced comparison.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Two fingerprints link when
they differ in at most `radius` bits; groups are the connected components of that relation.

How it scales: equal fingerprints collapse first (partial aggregation), so copies cost nothing more. The 64 bits are
cut into radius + 2 segments; fingerprints within the radius agree on at least two of them, so each pair of segments
is a table whose key holds about 26 bits, and no link is missed. Within one key the fingerprints are compared in bit-sliced
form. A key with many fingerprints is dealt into blocks of BLOCK and every pair of blocks is a separate unit of work,
so that no task holds a whole hot key. A unit returns a spanning forest of its links, never all of its pairs, and
components are found by alternating star contraction, with each round written to the shared folder. `similar_documents`
groups copies that share less than a radius of 3 bits allows: candidates by wider fingerprints, verified by the Jaccard similarity of shingle sets.

Defined results: null or blank text has fingerprint 0 (it links like any other); fewer words than a shingle make one
shingle of the whole sequence; repeated rows and repeated ids fall in one group; a group whose ids are all null has a
null component; empty tables give empty results; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, slices

#: Fingerprints in one block of a hot key.
BLOCK = 512
#: Groups up to this size compare as lists of pairs, all groups of a batch at once.
SMALL = 16


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned integer; only A-Z are lower-cased, words split at ASCII white space."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return 0
    joined, n = b" ".join(tokens), min(words, len(tokens))
    ends = [e - 1 for e in accumulate(len(t) + 1 for t in tokens)]
    starts = [0, *(e + 1 for e in ends[: len(tokens) - n])]
    digest = xxhash.xxh64_digest
    packed = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[n - 1 :], strict=True)]), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(packed), 255):  # sums of at most 255 bits stay in bytes
        counts += np.add.reduce(np.unpackbits(packed[i : i + 255], axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(packed)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                fps = np.array([fingerprint(t, words, seed) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.record_batch([part.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Vertical layout: row b holds bit b of every fingerprint, 64 of them to a word. fps: n words, or n x words for wide ones."""
    wide = fps.reshape(len(fps), -1)
    padded = np.zeros((-(-len(wide) // 64) * 64, wide.shape[1]), np.uint64)
    padded[: len(wide)] = wide
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def within(differing: np.ndarray, radius: int) -> np.ndarray:
    """Which lanes hold at most `radius` set bits. differing: 64 x any shape, bit planes of XORed fingerprints.

    Carry-save counters per lane: digits[k] is bit k of the count, `over` is set for good once the count passes the
    radius; words whose lanes are all over leave the computation.
    """
    shape = differing.shape[1:]
    rest = differing.reshape(differing.shape[0], -1)
    out = np.zeros(rest.shape[1], np.uint64)
    at = np.arange(rest.shape[1])
    size = radius.bit_length()
    start = (1 << size) - 1 - radius  # so that the first carry out of the digits says "over"
    digits = [np.full(len(at), np.uint64(0xFFFFFFFFFFFFFFFF) if start >> k & 1 else np.uint64(0)) for k in range(size)]
    over = np.zeros(len(at), np.uint64)
    for b in range(rest.shape[0]):
        carry = rest[b]
        for k in range(size):
            digits[k], carry = digits[k] ^ carry, digits[k] & carry
        over |= carry
        if b % 8 == 7 and b < rest.shape[0] - 8:
            live = over != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not live.any():
                return out.reshape(shape)
            if live.sum() < 0.7 * len(live):
                rest, over, at = rest[:, live], over[live], at[live]
                digits = [d[live] for d in digits]
    out[at] = ~over
    return out.reshape(shape)


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    """The first n lanes of packed words as booleans along the last axis."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Boolean matrix: which fingerprints of a and b are within the radius."""
    vertical = planes(b)
    out = np.empty((len(a), len(b)), bool)
    for i in range(0, len(a), 64):
        rows = np.ascontiguousarray(a[i : i + 64].reshape(-1, vertical.shape[0] // 64))
        bits = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little").T
        flips = np.where(bits > 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        out[i : i + 64] = lanes(within(vertical[:, None, :] ^ flips[:, :, None], radius), len(b))
    return out


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the smallest index of its component."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label, len(label)).min(axis=1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _unit_links(ids: np.ndarray, fps: np.ndarray, block: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as pairs of ids, within the units of work in sorted arrays."""
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[edges, len(group)])
    size_of = np.repeat(sizes, sizes)
    left, right = [ids[:0]], [ids[:0]]
    for s in range(1, SMALL):
        i = np.flatnonzero((group[:-s] == group[s:]) & (size_of[:-s] <= SMALL)) if s < len(group) else []
        if not len(i):
            break
        near = lanes(within(planes(fps[i] ^ fps[i + s]), radius), len(i))
        left.append(ids[i][near])
        right.append(ids[i + s][near])
    for at, n in zip(edges[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        own, part = fps[at : at + n], block[at : at + n]
        low = part == part.min()
        if low.all():
            linked = close_pairs(own, own, radius)
        else:  # two blocks: only what links across them
            linked = np.zeros((n, n), bool)
            across = close_pairs(own[low], own[~low], radius)
            linked[np.ix_(low, ~low)] = across
            linked[np.ix_(~low, low)] = across.T
        root = forest(linked)
        other = root != np.arange(n)
        left.append(ids[at : at + n][root[other]])
        right.append(ids[at : at + n][other])
    return np.concatenate(left), np.concatenate(right)


def _paired(dealt: DataFrame, radius: int) -> DataFrame:
    """(a, b) with a < b from rows (id, fp as bytes, block, unit): links enough to connect what links within each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _unit_links(*rows, radius)
            return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            ids, block, unit = (batch.column(k).to_numpy() for k in (0, 2, 3))
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8").astype(np.uint64).reshape(len(ids), -1)
            held.append((ids, fps, block, unit))
            if unit[0] != unit[-1]:  # all units but the last are whole
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.flatnonzero(rows[3] != rows[3][-1])[-1]) + 1
                held = [tuple(x[cut:] for x in rows)]
                yield out([x[:cut] for x in rows])
        if held:
            yield out([np.concatenate(x) for x in zip(*held, strict=True)])

    units = dealt.select("id", "fp", "block", "unit").repartition("unit").sortWithinPartitions("unit", "id")  # a forest's roots are smallest ids, so that units give the same links
    return units.mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def _deal(keyed: DataFrame, *carry: str) -> DataFrame:
    """Rows (id, key, carry) of keys that several rows hold, with block and unit: a key of many rows becomes a unit for every pair of its blocks."""
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return (
        keyed.join(shared, "key")
        .withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("id", *carry, "block", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("unit"))
    )


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) with a < b: links enough to connect every component of the distinct fingerprints fp."""
    cuts = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    segments = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    masks = [np.array([x | y], np.uint64).view(np.int64)[0].item() for x, y in combinations(segments, 2)]
    at = F.posexplode(F.array([F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "bits")
    keyed = distinct.select(F.col("fp").alias("id"), at).select("id", F.xxhash64("t", "bits").alias("key"))
    return _paired(_deal(keyed).withColumn("fp", F.unhex(F.lpad(F.hex("id"), 16, "0"))), radius)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that isn't the smallest of its component; edges: (a, b), materialized.

    Alternating large-star and small-star contraction: each round hangs neighbours on the smallest one known, so the
    number of rounds grows with the logarithm of the longest path.
    """
    mark, scratch, k = None, Scratch(edges.sparkSession, "components"), 0
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges, k = scratch.table(small, str(k + 1)), k + 1
        scratch.drop(str(k - 1))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(now)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest id of its group."""
    marked = materialize(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    edges = materialize(links(distinct, radius), "links")
    if edges.isEmpty():
        label = distinct.select("fp", F.col("rep").alias("component_id"))
    else:
        rooted = distinct.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
        label = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(label, "fp").select("doc_id", "fp", "component_id")


# --- groups by Jaccard similarity, for copies that share less: wide fingerprints compared in slices, pairs verified on whole sets

#: Words of 64 bits in a wide fingerprint, and the odd numbers that make as many hashes from one.
WIDE = 4
_MIX = np.arange(1, 2 * WIDE, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: The shares of wide fingerprints' radius: standard deviations above what pairs at the threshold differ by. Sets of fewer than FEW shingles are judged more loosely.
DEVIATIONS, FEW = 6, 50
#: A pair at the threshold is without a common key with a probability below e to the power of -CERTAIN (1e-8).
CERTAIN = 18.4
#: Of every document, the FIRST lowest shingles are counted; what COMMON documents hold there comes last in the order of shingles, but at most MOST_COMMON.
FIRST, COMMON, MOST_COMMON = 64, 128, 50_000
#: Nodes of one key, from which on they're first compared with one of them; nodes in one block of a hot key; shingles in one block of verified sets.
STAR, WIDE_BLOCK, SET_BLOCK = 32, 1024, 1 << 18
#: Keys of a unit by which pairs that meet under several keys are told apart at most; the others come twice and are merged later.
TOLD = 2048


def shingle_set(text: bytes | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; a blank text has that of no words."""
    tokens = text.lower().split() if text else []
    joined, n = b" ".join(tokens), min(words, len(tokens))
    ends = [e - 1 for e in accumulate(len(t) + 1 for t in tokens)]
    starts = [0, *(e + 1 for e in ends[: len(tokens) - n])]
    digest = xxhash.xxh64_digest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[n - 1 :], strict=True)] if tokens else [digest(b"", seed)]
    return np.unique(np.frombuffer(b"".join(hashes), ">i8").astype(np.int64))


def wide_fingerprint(own: np.ndarray) -> bytes:
    """The bitwise majority over a shingle set, WIDE words long."""
    x = own.view(np.uint64)[:, None] * _MIX
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    counts = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(x), 255):  # sums of at most 255 bits stay in bytes
        counts += np.add.reduce(np.unpackbits(x[i : i + 255].view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(own)).tobytes()


def wide_radius(similarity: float, few: bool = False, deviations: float = DEVIATIONS) -> int:
    """Bits in which pairs of sets of the similarity differ at most; of few shingles the share is larger than the angle between the sets."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi * (1.3 if few else 1)
    bits = 64 * WIDE
    return min(bits, int(np.ceil(bits * share + deviations * np.sqrt(bits * share * (1 - share)))))


def _needed(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles a set must share with any set of the similarity."""
    return np.ceil(similarity * sizes - 1e-9).astype(np.int64)


def set_keys(own: np.ndarray, last: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles under which a set looks for sets of the similarity.

    In any order of all shingles, the first that two such sets share is among the first keys of each unless all keys of one are unshared.
    At most 1 - similarity of a set is unshared, so n - needed + 1 keys are always enough, and in the random order of hashes a few are with CERTAIN.
    Shingles of many documents (last) come last, which leaves (1 - similarity) / rare as the share of the others that may be unshared, so
    that the fewer others there are the more keys it takes; sets that mostly hold such shingles use the plain order, those between use both.
    """
    n, off = len(own), 1 - similarity
    enough = n - int(_needed(np.array(n), similarity)) + 1
    late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own if len(last) else np.zeros(n, bool)
    rare = 1 - late.mean()
    keys = []
    if rare >= 1.5 * off:
        many = int(np.ceil(CERTAIN / np.log(rare / off))) if off else 1
        keys.append(own[~late][: min(enough, many)])
    if rare < 1.5 * off / similarity + off:
        keys.append(own[: min(enough, int(np.ceil(CERTAIN / -np.log(off))) if off else 1)])
    return np.unique(np.concatenate(keys))


def _common(rows: DataFrame, words: int, seed: int) -> np.ndarray:
    """The shingles that are among the lowest of many documents, in order, by counts over all of them; which ones come last decides the costs, not the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingle_set(t, words, seed)[:FIRST] for t in part.column(1).to_pylist()]
                yield pa.record_batch([pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))], names=["key"])

    counts = rows.select("doc_id", "text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    return np.sort(np.array([r["key"] for r in counts.orderBy(F.desc("n"), "key").limit(MOST_COMMON).collect()], np.int64))


def _deal_roots(keyed: DataFrame, across: bool = True) -> DataFrame:
    """Rows (id, size, root, fp, key, keys, place) of keys that hold several roots, with block and unit as in _deal; rows of a large key's most frequent root meet only the others.

    across: blocks of one key meet each other; else each is by itself.
    """
    roots = keyed.groupBy("key", "root").agg(F.count("*").alias("n"))
    shared = roots.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main")).filter("roots > 1")
    parts = lambda n: F.ceil(F.col(n) / WIDE_BLOCK).cast("int")
    placed = keyed.join(shared, "key").withColumn("small", F.col("n") <= WIDE_BLOCK).withColumn("most", F.when(F.col("small"), F.lit(0)).otherwise(F.col("main.n")))
    placed = placed.withColumn("rest", F.col("n") - F.col("most")).withColumn("mine", ~F.col("small") & (F.col("root") == F.col("main.root")))
    spread = lambda n: F.pmod(F.xxhash64("id"), parts(n)).cast("int")
    several = F.sequence(F.lit(0), F.when(F.col("mine"), parts("rest")).otherwise(parts("rest") + parts("most")) - 1)
    return (
        placed.withColumn("block", F.when(F.col("mine"), parts("rest") + spread("most")).otherwise(spread("rest")))
        .withColumn("other", F.explode(several if across else F.array("block")))
        .select("id", "size", "root", "fp", "block", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "key", "keys", "place")
    )


def _asked(ids: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Rows (unit, node, partners) for pairs of indices: a pair's unit follows from the places of both, and each node of a unit has a row, if only an empty one."""
    lo, hi = (f(place[i], place[j]).view(np.uint64) for f in (np.minimum, np.maximum))
    unit = (lo * np.uint64(0x9E3779B97F4A7C15) ^ hi).view(np.int64)
    order = np.lexsort((j, i, unit))
    unit, i, j = unit[order], i[order], j[order]
    starts = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (i[1:] != i[:-1])]) if len(i) else np.zeros(0, np.int64)
    others = np.unique(np.stack([unit, ids[j]]), axis=1)
    ends = np.r_[starts, np.full(others.shape[1] + 1, len(i))].astype(np.int32)
    columns = [pa.array(np.r_[unit[starts], others[0]]), pa.array(np.r_[ids[i[starts]], others[1]]), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[j]))]
    return pa.record_batch(columns, names=["unit", "node", "partners"])


def _met_before(key: int, keys: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Boolean matrix: which rows of low and high share a key below this one, by TOLD of the keys at most."""
    own = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    flat = np.concatenate(keys)
    own, flat = own[flat < key], flat[flat < key]
    names, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    frequent = np.argsort(-count, kind="stable")[:TOLD]
    column = np.full(len(names), -1)
    column[frequent[count[frequent] > 1]] = np.arange((count[frequent] > 1).sum())
    held = np.zeros((len(keys), max(1, int(column.max(initial=-1)) + 1)), np.float32)
    told = column[code] >= 0
    held[own[told], column[code[told]]] = 1
    return held[low] @ held[high].T > 0


def _candidates(dealt: DataFrame, similarity: float, likely: bool = False) -> DataFrame:
    """(unit, node, partners) as _asked makes them: pairs of different roots, whose sizes allow the similarity and whose fingerprints are within its radius.

    likely: only pairs as close as those at the threshold are on average, and in a larger unit one such pair for each of its nodes.
    """
    radii = [wide_radius(similarity, few, 0 if likely else DEVIATIONS) for few in (False, True)]

    def pairs(ids: np.ndarray, sizes: np.ndarray, roots: np.ndarray, fps: np.ndarray, block: np.ndarray, group: np.ndarray, key: np.ndarray, keys: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        def may(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            fit = (roots[i] != roots[j]) & (np.minimum(sizes[i], sizes[j]) >= _needed(np.maximum(sizes[i], sizes[j]), similarity))
            return i[fit], j[fit]

        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        counts = np.diff(np.r_[edges, len(group)])
        count_of = np.repeat(counts, counts)
        few = sizes < FEW
        for s in range(1, min(SMALL, len(group))):
            i = np.flatnonzero((group[:-s] == group[s:]) & (count_of[:-s] <= SMALL))
            for loose in (False, True):
                at, to = may(*(x[(few[i] | few[i + s]) == loose] for x in (i, i + s)))
                if len(at):
                    near = lanes(within(planes(fps[at] ^ fps[to]), radii[loose]), len(at))
                    yield _asked(ids, place, at[near], to[near])
        for at, n in zip(edges[counts > SMALL], counts[counts > SMALL], strict=True):
            rows = np.arange(at, at + n)
            low = high = rows
            if (other := block[rows] != block[rows].min()).any():  # two blocks: only what lies across them
                low, high = rows[~other], rows[other]
            near = close_pairs(fps[low], fps[high], radii[bool(few[rows].any())])
            if low is high:
                near = np.triu(near, 1)
            if not likely:
                near &= ~_met_before(key[at], list(keys[rows]), low - at, high - at)
            i, j = may(*(x[k] for x, k in zip((low, high), np.nonzero(near), strict=True)))
            if likely:
                one = np.unique(np.r_[np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1]])
                i, j = i[one], j[one]
            yield _asked(ids, place, i, j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            fps = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, WIDE)
            lists = np.empty(batch.num_rows, object)
            lists[:] = np.split(batch.column(7).flatten().to_numpy(), np.cumsum(batch.column(7).value_lengths().to_numpy())[:-1])
            held.append([{3: fps, 7: lists}.get(k, c.to_numpy(zero_copy_only=False)) for k, c in enumerate(batch.columns)])
            unit = held[-1][5]
            if unit[0] != unit[-1]:  # all units but the last are whole
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.flatnonzero(rows[5] != rows[5][-1])[-1]) + 1
                held = [[x[cut:] for x in rows]]
                yield from pairs(*(x[:cut] for x in rows))
        if held:
            yield from pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    units = dealt.repartition("unit").sortWithinPartitions("unit", "id")
    return units.mapInArrow(run, "unit long, node long, partners array<long>")


def _similar(nodes: list[int], partners: list[list[int]], sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """The pairs of one unit that have the similarity, by counts of the shingles in common."""
    index, sizes = {x: i for i, x in enumerate(nodes)}, np.array([len(x) for x in sets])
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    flags = np.zeros(len(names), np.int64)
    for i, asked in enumerate(partners):
        if not asked:
            continue
        js = np.array([index[x] for x in dict.fromkeys(asked)])
        own = codes[starts[i] : starts[i] + sizes[i]]
        flags[own] = 1
        if 8 * len(js) > len(nodes):
            both = np.add.reduceat(flags[codes], starts)[js]
        else:
            both = np.array([flags[codes[starts[j] : starts[j] + sizes[j]]].sum() for j in js])
        flags[own] = 0
        alike = both >= similarity * (sizes[i] + sizes[js] - both) - 1e-9
        yield from ((nodes[i], nodes[j]) for j in js[alike])


def _distance(x: str, y: str) -> str:
    """Differing bits of two wide fingerprints, in SQL."""
    word = lambda c, k: f"conv(hex(substring({c}, {8 * k + 1}, 8)), 16, -10)"
    return " + ".join(f"bit_count(cast({word(x, k)} as bigint) ^ cast({word(y, k)} as bigint))" for k in range(WIDE))


def _sets(rows: DataFrame, nodes: DataFrame, words: int, seed: int, scratch: Scratch, name: str) -> DataFrame:
    """(node, own): the shingle sets of the nodes (node, doc_id), from the rows (doc_id, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                own = [shingle_set(t, words, seed) for t in part.column(1).to_pylist()]
                yield pa.record_batch([pa.array([_node(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["node", "own"])

    ids = nodes.select("doc_id").distinct()
    own = rows.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(sets, "node long, own binary")  # as many ids as the corpus has copies: never broadcast
    return scratch.table(own.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]), name)  # rows of one id may hold several texts


def _verified(asked: DataFrame, first: DataFrame, rows: DataFrame, similarity: float, words: int, seed: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b), a < b, whose shingle sets have the similarity. asked: (unit, node, partners), first: (node, doc_id), rows: (doc_id, text).

    A set travels once to each unit that asks for it, however many pairs it has there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, ([], [], [])

        def out() -> pa.RecordBatch:
            found = np.array(list(_similar(*held, similarity)), np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], names=["a", "b"])

        for batch in batches:
            for own, node, partners, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if own != unit and held[0]:
                    yield out()
                    held = ([], [], [])
                unit = own
                for x, one in zip(held, (node, partners.as_py(), np.frombuffer(shingles.as_buffer(), np.int64)), strict=True):
                    x.append(one)
        if held[0]:
            yield out()

    asked = scratch.table(asked.groupBy("unit", "node").agg(F.flatten(F.collect_list("partners")).alias("partners")), f"{name}-asked")
    sets = _sets(rows, first.join(asked.select("node").distinct(), "node", "left_semi"), words, seed, scratch, f"{name}-sets")
    units = asked.join(sets, "node").select("unit", "node", "partners", "own").repartition("unit").sortWithinPartitions("unit")
    found = scratch.table(units.mapInArrow(run, "a long, b long").distinct(), name)
    scratch.drop(f"{name}-asked", f"{name}-sets")
    return found


def _rooted(keyed: DataFrame, play: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (id, key) with what units need of each node, and its root under the links found so far."""
    rooted = play.withColumn("root", F.col("id"))
    if not edges.isEmpty():
        rooted = play.join(components(edges).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    return keyed.select("id", "key").join(rooted, "id")


def _node(own: np.ndarray) -> int:
    """The hash that stands for a whole shingle set."""
    return int.from_bytes(xxhash.xxh64_digest(own.tobytes()), "big", signed=True)


def similar_documents(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(doc_id, text_id, component_id, first) for every row with an id: the groups that pairs of texts with this Jaccard similarity of their shingle sets, or more, connect.

    Texts with equal sets are one node. Nodes that share a key (set_keys) meet in units as in `links`, where their wide fingerprints are compared bit by bit
    in slices; what is within the radius for the similarity is verified on both whole sets, so no link is below it, and one is missed with a probability
    of about 1e-8. Two rounds keep large groups of near copies from being compared pair by pair: first the nodes of a key of more than STAR with one of
    them, and each node with one of its block that is likely close enough; then all pairs that aren't joined yet. text_id is Spark's xxhash64 of the text; first marks the row (or, if it repeats, rows) of the smallest
    (doc_id, text_id) of a group, component_id is its doc_id. Rows of one id and unlike texts are apart. Rows without an id take no part.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text.cast("string")).alias("text_id")).filter("doc_id IS NOT NULL")
    common = spark.sparkContext.broadcast(_common(rows, words, seed))  # at most MOST_COMMON numbers

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        for batch in batches:
            for part in slices(batch, 1):
                found = []
                for text in part.column(1).to_pylist():
                    own = shingle_set(text, words, seed)
                    found.append((_node(own), len(own), wide_fingerprint(own), set_keys(own, common.value, similarity)))
                columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.record_batch([part.column(0), part.column(2), *columns], names=["doc_id", "text_id", "node", "size", "fp", "keys"])

    with Scratch(spark, "similar") as scratch:
        marked = scratch.table(rows.mapInArrow(mark, "doc_id long, text_id long, node long, size long, fp binary, keys array<long>"), "marks")
        nodes = scratch.table(marked.groupBy("node").agg(F.min(F.struct("doc_id", "text_id")).alias("least"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
        each = nodes.select(F.col("node").alias("id"), F.explode("keys").alias("key"))
        several = each.groupBy("key").agg(F.count("*").alias("rows"), F.min(F.struct(F.xxhash64("id"), "id"))["id"].alias("center")).filter("rows > 1")
        keyed = scratch.table(each.join(several, "key").select("id", "key", "rows", "center"), "keys")
        found = keyed.groupBy("id").agg(F.collect_list("key").alias("keys"), F.max(F.struct("rows", "key"))["key"].alias("home")).join(nodes.select(F.col("node").alias("id"), "size", "fp"), "id")
        homes = found.groupBy("home").agg(F.ceil(F.sum("size") / SET_BLOCK).alias("parts"))  # nodes of one hottest key are verified together
        play = scratch.table(found.join(homes, "home").select("id", "size", "fp", "keys", F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("place")), "play")

        hot = keyed.filter(f"rows > {STAR} AND id <> center").groupBy("id", "center").agg(F.max("rows").alias("rows")).join(play.select("id", "fp"), "id")
        hot = hot.join(play.select(F.col("id").alias("center"), F.col("fp").alias("other")), "center").filter(f"{_distance('fp', 'other')} <= {wide_radius(similarity, True)}")
        star = hot.select(F.xxhash64("center", F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / BLOCK))).alias("unit"), "id", "center")
        none = F.array().cast("array<long>")
        star = star.select("unit", F.col("id").alias("node"), F.array("center").alias("partners")).unionByName(star.select("unit", F.col("center").alias("node"), none.alias("partners")).distinct())
        first = nodes.select("node", "least.doc_id")
        verify = lambda asked, name: _verified(asked, first, rows, similarity, words, seed, scratch, name)

        alone = keyed.select("id", "key").join(play.withColumn("root", F.col("id")), "id")
        edges = verify(star.unionByName(_candidates(_deal_roots(alone, across=False), similarity, likely=True)), "links-1")
        rooted = scratch.table(_rooted(keyed, play, edges), "rooted")
        scratch.drop("keys", "play")
        edges = edges.unionByName(verify(_candidates(_deal_roots(rooted), similarity), "links-2"))
        scratch.drop("rooted")
        label = nodes.select("node", F.col("node").alias("root"), "least")
        if not edges.isEmpty():
            label = nodes.select("node", "least").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
        smallest = label.groupBy("root").agg(F.min("least").alias("of"))
        named = label.join(smallest, "root").select("node", "of")
        out = marked.select("doc_id", "text_id", "node").join(named, "node")
        same = (F.col("doc_id") == F.col("of.doc_id")) & (F.col("text_id") == F.col("of.text_id"))
        return materialize(out.select("doc_id", "text_id", F.col("of.doc_id").alias("component_id"), same.alias("first")), "groups")
