"""Whole texts to token ids with the tokenizers library, each distinct chunk of a text encoded once per worker.

A text is cut before every single space and around every single line end that stands between two characters that aren't white space. The
pre-tokenizers of the vocabularies used here never let a token cross such a place, so the ids of a text are those of
its chunks in turn; the library sees every distinct chunk whole. Arrow cuts a slice of texts into chunks, finds the distinct ones
and puts their ids in place. Chunks seen before come from a memo that is emptied at MEMO entries, which bounds a worker's memory and changes no result.

Strings of special tokens in a text are ordinary text, as the notes that come with the vocabularies have it: a document must not be able to write
an end of document. A file with another pre-tokenizer or normalizer than those cuts are safe for is refused.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries after which a worker's memo starts anew.
MEMO = 500_000
#: Chunks beyond this many characters are encoded without being kept.
LONG = 48

#: Signs that may close a word and form a pre-token of their own behind it.
_SIGNS = ".,;:!?*$%&#|)"
#: Bytes that are white space, and characters of white space that take two or three bytes, as numbers of those bytes.
_WHITE = np.array([k < 128 and chr(k).isspace() for k in range(256)])
_WIDE = [int.from_bytes(chr(k).encode(), "big") for k in range(128, 1 << 16) if chr(k).isspace()]


def byte_letters() -> str:
    """One printable character for each byte: a character that prints in Latin-1 is itself, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


# The normalizers and pre-tokenizers, as their files state them, for which no token crosses a single space.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_WORDS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_LOWER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SAFE = (
    (None, _BYTES | {"use_regex": True}),
    ({"type": "Sequence", "normalizers": _LOWER}, {"type": "Sequence", "pretokenizers": [_WORDS, _BYTES | {"use_regex": False}]}),
)


def cut(data: np.ndarray) -> np.ndarray:
    """Where to cut UTF-8 bytes: before each single space and around each single line end among other characters."""
    white = _WHITE[data]
    for size, lead in ((2, data == 0xC2), (3, (data >= 0xE1) & (data <= 0xE3))):
        at = np.flatnonzero(lead[: len(data) - size + 1])
        found = at[np.isin(sum(data[at + k].astype(np.int64) << 8 * (size - 1 - k) for k in range(size)), _WIDE)]
        for k in range(size):
            white[found + k] = True
    single = white.copy()
    single[1:] &= ~white[:-1]
    single[:-1] &= ~white[1:]
    ends = single & (data == 0x0A)
    first = ends | single & (data == 0x20)
    first[1:] |= ends[:-1]
    return np.flatnonzero(first)


class ChunkCoder:
    """encode: distinct chunks to lists of ids. A memo maps chunks to their ids as little-endian uint32 bytes."""

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]]):
        self.encode, self.memo = encode, {}

    def _new(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks that the memo doesn't hold."""
        return [array("I", ids).tobytes() for ids in self.encode(chunks)]

    def _distinct(self, chunks: list[str]) -> list[bytes]:
        memo = self.memo
        found = list(map(memo.get, chunks))
        new = [c for c, ids in zip(chunks, found, strict=True) if ids is None]
        if not new:
            return found
        if len(memo) > MEMO:
            memo.clear()
        coded = self._new(new)
        memo.update((c, ids) for c, ids in zip(new, coded, strict=True) if len(c) <= LONG)
        rest = iter(coded)
        return [next(rest) if ids is None else ids for ids in found]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; a null has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        low, high = int(bounds[0]), int(bounds[-1])
        if low == high:
            return [b""] * len(texts)
        bounds, data = bounds - low, data.slice(low, high - low)
        first = np.zeros(high - low + 1, bool)
        first[cut(np.frombuffer(data, np.uint8))] = True
        first[bounds] = True
        starts = np.flatnonzero(first)
        chunks = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), data).dictionary_encode()
        placed = pa.array(self._distinct(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(chunks.indices)
        _, offsets, ids = placed.buffers()
        ends, ids = np.frombuffer(offsets, np.int64)[np.searchsorted(starts, bounds)].tolist(), memoryview(ids)
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]


class LibraryCoder(ChunkCoder):
    """Chunks by the tokenizers library.

    A new chunk that is a Latin word with or without closing signs is a pre-token or two in both kinds of vocabulary, so the
    library's model merges the word at once, and words are kept apart from their signs. All others go through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if (told["normalizer"], told["pre_tokenizer"]) not in SAFE or told["truncation"] or told["padding"]:
            raise ValueError(f"{path}: whether texts may be cut at spaces is not known for its normalizer and pre-tokenizer")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.lower = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A") == "a"
        self.letters = dict(enumerate(byte_letters()))
        self.packed = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.signs: dict[str, bytes] = {}
        super().__init__(lambda chunks: (e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)) if chunks else ())

    def _new(self, chunks: list[str]) -> list[bytes]:
        """A word with signs behind it takes or leaves the word in the memo. White space before a word is a letter of it or, where letters are lowered, dropped."""
        memo, merge, packed, letters, lower = self.memo, self.merge, self.packed, self.letters, self.lower
        space = "" if lower else letters[ord(" ")]
        out, others = [], []
        for chunk in chunks:
            word = chunk.rstrip(_SIGNS)
            led = word[:1] == " "
            bare = word[1:] if led else word
            if lower:
                bare = bare.lower()
            ascii_only = bare.isascii()
            if not (bare.isalpha() and len(bare) <= LONG and (ascii_only or max(bare) < "\u0250")):
                out.append(None)
                others.append(chunk)
                continue
            alone = len(word) == len(chunk)
            ids = None if alone else memo.get(word)
            if ids is None:
                if not ascii_only:
                    bare = bare.encode().decode("latin-1").translate(letters)
                ids = b"".join([packed[t.id] for t in merge(space + bare if led else bare)])
                if not alone:
                    memo[word] = ids
            out.append(ids if alone else ids + self._tail(chunk[len(word) :]))
        rest = iter(super()._new(others))
        return [next(rest) if ids is None else ids for ids in out]

    def _tail(self, tail: str) -> bytes:
        ids = self.signs.get(tail)
        if ids is None:
            if len(self.signs) > MEMO:
                self.signs.clear()
            ids = self.signs[tail] = super()._new([tail])[0]
        return ids


@lru_cache(maxsize=2)
def library_coder(path: str) -> ChunkCoder:
    """The coder of a worker process over a byte-level BPE file of the tokenizers library; strings of special tokens in a text are ordinary text."""
    return LibraryCoder(path)
