"""Byte-level BPE by a SentencePiece model serialised from a rank file.

The vocabulary of the rank file becomes the pieces of a BPE model: every byte of a token is written as one printable
character, the score is the negative rank, and the normaliser is the identity, so the library's merges by best score
are merges by lowest rank. Each match of the pre-token pattern is encoded on its own; decoding maps pieces back to bytes.
A pre-token that is itself in the vocabulary is that one id, merges or not, as rank-based encoders have it.

Defined results: null or empty text has no ids and decodes to no bytes; repeated rows and ids keep one row each;
very long texts are encoded whole; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .token_ids import ChunkCoder, byte_letters

# Fields of the serialised model (field number, wire type) and the enumeration values used.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
MODEL_TYPE, BPE, UNK_ID, BOS_ID, EOS_ID, PAD_ID, VOCAB_SIZE = 3, 2, 40, 41, 42, 43, 4
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5
NORMAL, UNKNOWN = 1, 2


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank."""
    with open(path, "rb") as f:
        ranked = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without a gap")
    return [ranked[i] for i in range(len(ranked))]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        import struct

        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialize_model(tokens: list[bytes]) -> bytes:
    """A SentencePiece BPE model whose ids are the ranks; the unknown piece, which no text can reach, comes last."""
    letters = byte_letters()
    out = []
    for rank, token in enumerate(tokens):
        piece = token.decode("latin-1").translate(letters).encode()
        out.append(_field(PIECES, _field(PIECE, piece) + _field(SCORE, -float(rank)) + _field(TYPE, NORMAL)))
    out.append(_field(PIECES, _field(PIECE, b"<unk>") + _field(SCORE, 0.0) + _field(TYPE, UNKNOWN)))
    n = len(tokens)
    out.append(_field(TRAINER, _field(MODEL_TYPE, BPE) + _field(VOCAB_SIZE, n + 1) + _field(UNK_ID, n) + _field(BOS_ID, -1) + _field(EOS_ID, -1) + _field(PAD_ID, -1)))
    out.append(_field(NORMALIZER, _field(NAME, b"identity") + b"".join(_field(k, 0) for k in (ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES))))
    return b"".join(out)


class ByteBpe:
    """Encode and decode with a rank file; pattern splits texts into pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        self.letters = byte_letters()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialize_model(self.tokens))
        self.find = regex.compile(pattern).findall
        self.coder = ChunkCoder(self._encode)

    def _encode(self, chunks: list[str]) -> Iterator[list[int]]:
        raw = [[m.encode() for m in self.find(chunk)] for chunk in chunks]
        todo = list({m for ms in raw for m in ms if m not in self.rank})
        merged = dict(zip(todo, self.model.encode([m.decode("latin-1").translate(self.letters) for m in todo], num_threads=1), strict=True))
        for ms in raw:
            ids: list[int] = []
            for m in ms:
                if (whole := self.rank.get(m)) is not None:
                    ids.append(whole)
                else:
                    ids += merged[m]
            yield ids

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian uint32 bytes."""
        return self.coder(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


_OPEN: dict[tuple[str, str], ByteBpe] = {}


def _bpe(path: str, pattern: str) -> ByteBpe:
    """One model per worker process, as building it takes a while."""
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = ByteBpe(path, pattern)
    return _OPEN[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian uint32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                ids = bpe.encode(part.column(1))
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): decoded as bytes, which are the text's UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                decoded = pa.array([bpe.decode(x) for x in part.column(1).to_pylist()], pa.binary())
                yield pa.record_batch([part.column(0), part.column(1), decoded], names=["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), encoded and decoded in turn."""
    done = decode(encode(docs, path, pattern), path, pattern)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
