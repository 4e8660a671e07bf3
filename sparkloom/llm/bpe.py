"""Operator 8: byte-level BPE encoding and decoding with a bitmap rank queue.

A pre-token's bytes are a linked list of tokens.  Every adjacent pair that the
vocabulary merges lies, by its left position, in the bucket of its merge rank,
and a two-level bitmap has a bit for every bucket that isn't empty: a summary
of groups of 256 ranks, and the ranks of each group.  Find-first-set on both
levels gives the least rank in constant time; the leftmost position of that
bucket is merged, if it isn't stale (its pair may have changed since), and the
two new pairs are queued.  A pre-token of n bytes takes O(n log n) however long
it is.

Texts are cut into pre-tokens by comparing the classes (letter, number, space,
other) of neighbouring bytes, a whole step of texts at once; no Python object is
made for a pre-token.  Pre-tokens are looked up by a 64-bit hash among those that
the worker has met (`KEPT` at most; then it starts anew), and only new ones go
through the queue.  The ids are decoded again by gathering the tokens' bytes, and
compared with the text; a text that differs (two pre-tokens of one hash) is cut by
the regular expression and encoded piece by piece.  The vocabulary's bytes are
broadcast (under 1 MB).

Nulls: a null text has null ids, n_tokens and exact; an empty text an empty list.
Very long texts are encoded whole; their pre-tokens are looked up in slabs of
`SLAB` bytes.  Repeated rows are encoded once for each row.  There are no ties: of
two places of one rank the left one merges first.  An empty table gives an empty
result; further columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import take

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
KEPT, STEP, SLAB = 1_000_000, 8 << 20, 8 << 20
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_SLOTS = 1 << 20
_classes: list[np.ndarray] = []


def _class_of() -> np.ndarray:
    """The class of every code point, by the same regular expressions as PATTERN's."""
    if not _classes:
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        table = np.full(0x110000, _OTHER, np.uint8)
        for kind, p in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            for m in regex.finditer(p, every):
                table[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
        table[0xD800:0xE000] = _OTHER
        _classes.append(table)
    return _classes[0]


def starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first bytes of the pre-tokens of some texts, as PATTERN cuts them; offsets: of the texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    table = _class_of()
    cls = table[:256][data]
    wide = np.zeros(0, np.int64)  # spaces of several bytes
    high = data >= 128
    if high.any():
        lead = np.flatnonzero(data >= 192)
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 224) + (first >= 240)
        tail = [np.where(size > k, data[np.minimum(lead + k, n - 1)], 0).astype(np.int32) & 63 for k in (1, 2, 3)]
        code = np.where(size == 2, (first & 31) << 6 | tail[0], np.where(size == 3, (first & 15) << 12 | tail[0] << 6 | tail[1], (first & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
        kind = table[code]
        cls[lead] = kind
        for k in (1, 2, 3):
            cls[(lead + k)[size > k]] = kind[size > k]
        wide = lead[kind == _SPACE]
        width = size[kind == _SPACE]
    new = np.zeros(n + 1, bool)
    new[offsets] = True
    space = cls == _SPACE
    after = np.ones(n, bool)  # the next character is no space, or the text ends
    after[:-1] = ~space[1:]
    last = space & after  # of its run
    if len(wide):
        for k in (0, 1, 2):
            inner = wide[width > k + 1] + k
            last[inner] = False
        end = wide + width
        last[wide + width - 1] = False
        last[wide] = np.where(end < n, ~space[np.minimum(end, n - 1)], True)
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1  # the texts' last bytes: their spaces end a text, so the run isn't split
    last[ends] = False
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    if len(wide):
        at_end = np.isin(wide + width - 1, ends)
        last[wide[at_end]] = False
    out = np.empty(n, bool)
    out[0] = True
    out[1:] = cls[1:] != cls[:-1]
    glued = np.zeros(n, bool)  # follows a blank that it takes along
    glued[1:] = (data[:-1] == 32) & ~space[1:]
    out &= ~glued
    out |= last
    out[begins] = True
    # contractions: an apostrophe that begins a pre-token
    q = np.flatnonzero((data == 39) & out)
    if len(q):
        bound = offsets[np.searchsorted(offsets, q, "right")]
        one, two = np.where(q + 1 < bound, data[np.minimum(q + 1, n - 1)], 0), np.where(q + 2 < bound, data[np.minimum(q + 2, n - 1)], 0)
        short = np.isin(one, np.frombuffer(b"sdmt", np.uint8))
        long_ = ((one == 108) & (two == 108)) | ((one == 118) & (two == 101)) | ((one == 114) & (two == 101))
        for found, size in ((q[short], 2), (q[long_ & ~short], 3)):
            out[found + 1] = False
            to = found + size
            inside = (to < n) & ~new[np.minimum(to, n)]
            to = to[inside]
            out[to[~space[to]]] = True
    return np.flatnonzero(out)



class Codec:
    """Encoder and decoder, with the pre-tokens met so far."""

    def __init__(self, raw: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.byte_ids = np.array(self.bytes, np.int32)
        get = self.ranks.get
        self.pairs = {(x << 20) | y: r for t, r in self.ranks.items() for k in range(1, len(t)) if (x := get(t[:k])) is not None and (y := get(t[k:])) is not None}
        self.split = regex.compile(pattern).findall
        keys, ranks = (np.fromiter(x, np.int64, len(self.pairs)) for x in (self.pairs.keys(), self.pairs.values()))
        order = np.argsort(keys)
        self.pair_key, self.pair_rank = keys[order], ranks[order].astype(np.int32)
        top = max(self.tokens) + 1
        self.size = np.array([len(self.tokens.get(r, b"")) for r in range(top)], np.int32)
        self.place = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(self.tokens.get(r, b"") for r in range(top)), np.uint8)
        spans = np.cumsum([len(t) for t in self.tokens.values()])
        hashes = tk.hash_spans(np.frombuffer(b"".join(self.tokens.values()), np.uint8), np.r_[0, spans[:-1]], spans)
        order = np.argsort(hashes)
        self.token_hash, self.token_id = hashes[order], np.fromiter(self.tokens, np.int32)[order]
        self.reset()

    def reset(self) -> None:
        """Forgets the pre-tokens; slots: the hash and number of the last pre-token met of each slot."""
        self.slot_hash, self.slot_at = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32)
        self.first, self.count, self.pool = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)
        self.known = self.used = 0

    def one(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        r = self.ranks.get(raw)
        return [r] if r is not None else self.merge(raw)

    def _learn(self, h: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of new pre-tokens of distinct hashes."""
        at = np.minimum(np.searchsorted(self.token_hash, h), len(self.token_hash) - 1)
        whole = self.token_hash[at] == h
        size = b - a
        count = np.ones(len(h), np.int64)
        rest = np.flatnonzero(~whole)
        ids, count[rest] = self.merge_all(data[tk.ranges(a[rest], size[rest])], size[rest])
        first = np.cumsum(count) - count
        n, k, m = self.known, self.used, int(count.sum())
        while n + len(h) > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while k + m > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.first[n : n + len(h)], self.count[n : n + len(h)] = first + k, count
        self.pool[k + first[whole]] = self.token_id[at[whole]]
        self.pool[k + tk.ranges(first[rest], count[rest])] = ids
        self.known, self.used = n + len(h), k + m
        return np.arange(n, n + len(h))

    def _numbers(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each pre-token."""
        h = tk.hash_spans(data, a, b)
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        at = self.slot_at[slot].astype(np.int64)
        miss = np.flatnonzero(self.slot_hash[slot] != h)
        if len(miss):
            new, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            got = self._learn(new, data, a[miss][where], b[miss][where])
            at[miss] = got[back]
            s, unlike = np.unique(slot[miss][where], return_index=True)
            self.slot_hash[s], self.slot_at[s] = new[unlike], got[unlike]
        return at

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The merge ranks of pairs; -1 where there is none."""
        key = x.astype(np.int64) << 20 | y
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], np.int32(-1))

    def merge_all(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) of pre-tokens that follow one another in `data`.

        One queue serves all of them: lists end at their borders, and while ranks only
        ascend, all places of a bucket can merge at once (of overlapping ones the left).
        A pre-token that gets a pair of a lesser rank than the one just merged, which
        hardly happens, is encoded anew with a queue of its own.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        ids = np.append(self.byte_ids[data], np.int32(-1))
        end = np.cumsum(size)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[end - 1], before[end - size] = n, n  # place n is none
        rank = np.full(n + 1, -1, np.int32)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        buckets: dict[int, list[np.ndarray]] = {}
        groups: dict[int, int] = {}
        summary = 0
        fresh = inner[rank[inner] >= 0].astype(np.int32)
        alone: list[np.ndarray] = []
        while True:
            if len(fresh):
                r = rank[fresh]
                order = np.argsort(r, kind="stable")
                fresh, r = fresh[order], r[order]
                cut = np.flatnonzero(r[1:] != r[:-1]) + 1
                cut = [0, *cut.tolist(), len(r)]
                for k, x in enumerate(r[cut[:-1]].tolist()):
                    part = fresh[cut[k] : cut[k + 1]]
                    if x in buckets:
                        buckets[x].append(part)
                    else:
                        buckets[x] = [part]
                        g = x >> 8
                        bits = groups.get(g, 0)
                        if not bits:
                            summary |= 1 << g
                        groups[g] = bits | 1 << (x & 255)
            if not summary:
                break
            g = (summary & -summary).bit_length() - 1
            bits = groups[g]
            low = bits & -bits
            x = (g << 8) + low.bit_length() - 1
            groups[g] = bits ^ low
            if bits == low:
                summary ^= 1 << g
            at = buckets.pop(x)
            at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            at = at[rank[at] == x]  # the others are stale
            to = after[at]
            if (to[:-1] == at[1:]).any():
                keep, last = [], -1
                for k, (i, j) in enumerate(zip(at.tolist(), to.tolist())):
                    if i != last:
                        keep.append(k)
                        last = j
                at, to = at[keep], to[keep]
            ids[at] = x
            ids[to] = rank[to] = -1
            to = after[to]
            after[at], before[to] = to, at
            left = before[at]
            # the pairs from these places on, and those from the places before
            x_ = np.full(len(at), x, np.int32)
            both = self._ranks(np.concatenate([x_, ids[left]]), np.concatenate([ids[to], x_]))
            both[: len(at)][to == n] = -1
            fresh = np.concatenate([at, left])
            rank[fresh] = both
            rank[n] = -1
            some = (both >= 0) & (fresh < n)
            if (less := some & (both < x)).any():
                alone.append(fresh[less])
            fresh = fresh[some]
        if alone:
            for k in np.unique(np.searchsorted(end, np.concatenate(alone), "right")).tolist():
                i, j = int(end[k] - size[k]), int(end[k])
                own = self.merge(data[i:j].tobytes())
                ids[i : i + len(own)], ids[i + len(own) : j] = own, -1
        some = ids[:n] >= 0
        total = np.r_[0, np.cumsum(some)]
        return ids[:n][some], np.diff(total[np.r_[0, end]])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text, whether decoding gives the text again); a null counts as empty."""
        data, offsets = tk.buffers(pc.fill_null(texts, ""))
        if self.known > KEPT or self.used > 16 * KEPT:
            self.reset()
        a = starts(data, offsets)
        b = np.r_[a[1:], len(data)][: len(a)]
        parts, lo = [np.zeros(0, np.int32)], 0
        counts = np.zeros(len(a), np.int64)
        while lo < len(a):  # some pre-tokens at a time
            hi = max(lo + 1, int(np.searchsorted(b, a[lo] + SLAB, "right")))
            at = self._numbers(data, a[lo:hi], b[lo:hi])
            n = counts[lo:hi] = self.count[at]
            ids = self.pool[tk.ranges(self.first[at], n)]
            parts.append(ids)
            lo = hi
        ids = np.concatenate(parts)
        total = np.r_[0, np.cumsum(counts)]
        cut = total[np.searchsorted(a, offsets)]
        exact = self._same(ids, cut, data, offsets)
        if not exact.all():
            pieces = [ids[cut[k] : cut[k + 1]] if exact[k] else self.encode(texts[k].as_py()) for k in range(len(exact))]
            ids, cut = np.concatenate(pieces), np.r_[0, np.cumsum([len(x) for x in pieces])]
            exact = self._same(ids, cut, data, offsets)
        return ids, np.diff(cut), exact

    def _same(self, ids: np.ndarray, cut: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the ids from cut[k] to cut[k + 1] decode to the bytes from offsets[k] to offsets[k + 1]."""
        size = self.size[ids]
        end = np.r_[0, np.cumsum(size, dtype=np.int64)]
        fine = np.diff(end[cut]) == np.diff(offsets)
        if not fine.all():
            return np.array([bool(ok) and self.letters[tk.ranges(self.place[ids[i:j]], size[i:j])].tobytes() == data[x:y].tobytes() for ok, i, j, x, y in zip(fine, cut[:-1], cut[1:], offsets[:-1], offsets[1:])], bool)
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(end, end[lo] + SLAB, "right")) - 1)
            wrong = np.flatnonzero(self.letters[tk.ranges(self.place[ids[lo:hi]], size[lo:hi])] != data[end[lo] : end[hi]])
            if len(wrong):
                fine[np.searchsorted(offsets, wrong + end[lo], "right") - 1] = False
            lo = hi
        return fine

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        pair, n = self.pairs.get, len(raw)
        ids = [self.bytes[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        groups: dict[int, int] = {}
        summary = 0
        for i in range(n - 1):
            r = pair((ids[i] << 20) | ids[i + 1])
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)  # ascending positions are a heap
                else:
                    buckets[r] = [i]
                    g = r >> 8
                    groups[g] = groups.get(g, 0) | (1 << (r & 255))
                    summary |= 1 << g
        while summary:
            g = (summary & -summary).bit_length() - 1
            bits = groups[g]
            low = bits & -bits
            r = (g << 8) + low.bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                groups[g] = bits ^ low
                if bits == low:
                    summary ^= 1 << g
            j = after[i]
            if ids[i] < 0 or j >= n or pair((ids[i] << 20) | ids[j]) != r:
                continue  # stale
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            h = before[i]
            fresh = []
            if k < n:
                before[k] = i
                fresh.append((pair((r << 20) | ids[k]), i))
            if h >= 0:
                fresh.append((pair((ids[h] << 20) | r), h))
            for r2, at in fresh:
                if r2 is not None:
                    if r2 in buckets:
                        heappush(buckets[r2], at)
                    else:
                        buckets[r2] = [at]
                        g2 = r2 >> 8
                        groups[g2] = groups.get(g2, 0) | (1 << (r2 & 255))
                        summary |= 1 << g2
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text, cut by the regular expression."""
        return np.array([i for piece in self.split(text) for i in self.one(piece.encode())], np.int32)

    def decode(self, ids) -> str:
        """The text; ids that aren't whole characters give replacement characters."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode(errors="replace")


_codecs: dict[int, Codec] = {}


def _codec(raw: bytes) -> Codec:
    key = hash(raw)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(raw)
    return _codecs[key]


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """For every row: doc_id, ids, n_tokens, and whether decoding the ids gives the text again."""
    with open(vocabulary, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    d = take(docs, id_col, text_col).toDF("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value)
        for b in batches:
            for at, texts in tk.steps(b.column("text"), STEP):
                null = np.asarray(texts.is_null())
                ids, number, exact = codec.encode_all(texts)
                cut = pa.array(np.r_[0, np.cumsum(number)].astype(np.int32), mask=np.r_[null, False])
                lists = pa.ListArray.from_arrays(cut, pa.array(ids))
                yield pa.record_batch([b.column("doc_id").slice(at, len(texts)), lists, pa.array(number.astype(np.int32), mask=null), pa.array(exact, mask=null)], ["doc_id", "ids", "n_tokens", "exact"])

    kind = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens int, exact boolean")


def decode(tokens: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of lists of ids; null for null."""
    with open(vocabulary, "rb") as f:
        raw = tokens.sparkSession.sparkContext.broadcast(f.read())
    d = take(tokens, id_col, ids_col).toDF("doc_id", "ids")

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(raw.value)
        for ids in batches:
            yield pa.array([None if x is None else codec.decode(x) for x in ids.to_pylist()], pa.string())

    return d.select("doc_id", run("ids").alias("text"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
