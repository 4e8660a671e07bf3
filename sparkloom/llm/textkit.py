"""Vectorised text primitives shared by the operators of this subpackage.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters of the lower-cased text; everything else separates words.  Arrow
string buffers are scanned with numpy, so the cost is a few nanoseconds a byte
and no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step handles; one longer text is a step of its own.
STEP_BYTES = 2 << 20

_IS_WORD = np.zeros(256, bool)
_IS_WORD[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = True
_IS_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full((1 << 16) - 1, _BASE, np.uint64))])
WORD_PATTERN = r"[0-9a-z\u0080-\U0010ffff]+"


def release() -> None:
    """Gives freed memory back to the system at the end of a partition, as workers go on to other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, elementwise."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_word(word: str) -> int:
    """The hash that `Words` gives to one word."""
    return int(Words.of(pa.array([word])).h[0])


def steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) pieces of at most about `limit` bytes of text."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    at, n = 0, len(texts)
    total = np.concatenate([[0], np.cumsum(size)])
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls, offsets from 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    count = np.asarray(count)
    end = np.cumsum(count, dtype=np.int64)
    return np.repeat(first - (end - count), count) + np.arange(int(end[-1]) if len(end) else 0)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of adjoining spans of bytes, none empty: end[k] is start[k + 1]."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    begin = start - start[0]
    inside = np.arange(int(end[-1] - start[0]), dtype=np.int32)
    inside -= np.repeat(begin.astype(np.int32), size)
    inside &= 0xFFFF
    part = _POWERS[inside]
    part *= data[start[0] : end[-1]].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(part, begin) + size.astype(np.uint64) * _BASE)


class Words:
    """The words of some texts: `doc`, `start`, `end` and 64-bit hash `h` of each."""

    __slots__ = ("data", "offsets", "doc", "start", "end", "h", "n_docs")

    @classmethod
    def of(cls, texts: pa.Array, lower: bool = True) -> "Words":
        texts = pc.fill_null(texts, "")
        data, offsets = buffers(pc.utf8_lower(texts) if lower else texts)
        return cls(data, offsets)

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        n = len(data)
        if not n:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.h = np.zeros(0, np.uint64)
            return
        w = _IS_WORD[data]
        gap = np.zeros(n + 1, bool)  # a text begins here
        gap[offsets] = True
        first = w.copy()
        first[1:] &= ~w[:-1] | gap[1:n]
        last = w.copy()
        last[:-1] &= ~w[1:] | gap[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        size = self.end - self.start
        if not len(size):
            self.h = np.zeros(0, np.uint64)
            return
        begin = np.cumsum(size) - size
        inside = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
        part = _POWERS[inside & 0xFFFF]
        part *= data[w].astype(np.uint64) + np.uint64(1)
        self.h = mix(np.add.reduceat(part, begin) + size.astype(np.uint64) * _BASE)

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.doc, minlength=self.n_docs)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of the n-word shingles; a text of 1 to n-1 words is one shingle."""
        if not len(self.h):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        number = self.counts()
        first = np.cumsum(number) - number
        place = np.arange(len(self.h)) - first[self.doc]
        size = number[self.doc]
        keep = np.flatnonzero((place + n <= size) | ((place == 0) & (size < n)))
        h = np.zeros(len(keep), np.uint64)
        top = len(self.h) - 1
        for k in range(n):
            ok = place[keep] + k < size[keep]
            h = h * _BASE + np.where(ok, self.h[np.minimum(keep + k, top)], np.uint64(0))
        return self.doc[keep], mix(h)


def set_of(shingle_docs: np.ndarray, shingle_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, hash), ordered by both."""
    order = np.lexsort((shingle_hashes, shingle_docs))
    d, h = shingle_docs[order], shingle_hashes[order]
    if len(d):
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        d, h = d[new], h[new]
    return d, h
