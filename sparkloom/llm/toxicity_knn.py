"""Operator 5: toxicity from the nearest labelled examples by exact TF-IDF cosine.

A bounded sample of labelled documents (`SAMPLE` rows; near copies among them count once)
gives the vocabulary, all of its words, and the examples.  A word's weight in a text is
(1 + log of its count) * inverse document frequency * (`FLOOR` + its tie to the label).
The tie, between 0 and 1, grows with the chi-squared statistic of the word's presence and
with its log odds in toxic documents; no word is left out, but the cosine of invented or
topical words doesn't drown the evidence.

The examples are kept in an inverted index whose postings lie in blocks of `BLOCK`
examples, with the greatest weight of each term in each block.  For each query the sums
of these bound the blocks; blocks are visited in waves by descending bound, until no
block left can hold one of the K nearest.  So every text that has a word of the
vocabulary gets its exact neighbours.  They vote with weight 1 / (distance + `SOFT`);
leave-one-out votes of the sample, made monotone, calibrate the score.

Ids are whole numbers; a column of another type is refused.  Nulls: a null or empty text,
or one without a word of the vocabulary, has the score of sample documents without a word
(0 if there is none), and no evidence.  Rows with null ids or texts, and labels other than 0
and 1, don't take part in the sample.  Without labels every score is 0; with labels of
one kind only, every text that has a neighbour gets that label.  Texts are scored whole,
however long.  Ties in cosine (to 12 digits) go to the example with the least id.
Repeated rows are scored once for each row.  An empty table gives an empty result;
further columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_dedup
from . import textkit as tk
from .common import labelled_sample, take

SAMPLE, K, BLOCK, SOFT, LEAST = 6000, 15, 256, 0.05, 0.5
#: Weight of words without a tie to the label; chi-squared at which a tie is half; log odds of a whole tie; tie from which a word is reported.
FLOOR, HALF, ODDS, TELLS = 0.05, 10.0, 4.0, 0.25
#: Blocks of the first waves; queries at a time; of so many examples one holds a common term.
WAVES, QUERIES, OFTEN = (2, 5), 64, 16


def _no_copies(texts: pa.Array) -> np.ndarray:
    """Places of the texts that share no MinHash band with an earlier one."""
    seen: set[int] = set()
    keep = []
    for at, s in tk.steps(texts):
        d, sig = near_dedup.signatures(*tk.Words.of(s).shingles(3), 48)
        keys = dict(zip(d.tolist(), near_dedup.band_keys(sig, 12, 4).tolist())) if len(d) else {}
        for k in range(len(s)):
            own = keys.get(k, [])
            if seen.isdisjoint(own):
                keep.append(at + k)
            seen.update(own)
    return np.array(keep, np.int64)


def term_counts(texts: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, term, count), by doc and term, of the words of a sorted vocabulary of hashes."""
    w = tk.Words.of(texts)
    if not len(vocabulary) or not len(w.h):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(vocabulary, w.h), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == w.h)
    key, n = np.unique(w.doc[hit] * len(vocabulary) + at[hit], return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), n


class Index:
    """Block-max inverted index over unit vectors, given by (example, term, weight).

    The lists of terms that at least one example in `OFTEN` holds are kept as rows of a
    matrix: a product gives their part of the cosines at once, which the bounds then
    hold exactly, so blocks differ by the rarer terms.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, x: np.ndarray, size: int, terms: int, order: np.ndarray | None = None, block: int = BLOCK):
        self.size, self.block_size, self.blocks = size, block, -(-size // block)
        self.example = np.arange(size) if order is None else order  # by place; like examples in one block make its bounds tight
        place = np.empty(size, np.int64)
        place[self.example] = np.arange(size)
        at = place[doc].astype(np.int32)
        by = np.lexsort((at, term))
        at, term, x = at[by], term[by], x[by]
        del by
        often = np.bincount(term, minlength=terms) * OFTEN >= size
        self.row = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        common = often[term]
        self._common, self._rows = (self.row[term[common]], at[common], x[common]), None
        at, term, self.x = at[~common], term[~common], x[~common]
        self.place = at
        new = np.r_[True, (term[1:] != term[:-1]) | (at[1:] // block != at[:-1] // block)] if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.first = np.r_[first, len(at)].astype(np.int32)
        self.block = at[first] // np.int32(block)
        most = np.maximum.reduceat(self.x, first) if len(at) else self.x
        self.most = np.nextafter(most.astype(np.float32), np.float32(np.inf))  # not under the true one
        self.head = np.searchsorted(term[first], np.arange(terms + 1)).astype(np.int32)

    def rows(self) -> np.ndarray:
        """(common terms, examples) weights."""
        if self._rows is None:
            self._rows = np.zeros((int(self.row.max(initial=-1)) + 1, self.size))
            self._rows[self._common[:2]] = self._common[2]
        return self._rows

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rows": None}

    def nearest(self, q: np.ndarray, t: np.ndarray, x: np.ndarray, n: int, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, cosine, example) of the k greatest cosines of each of n queries, exactly; equal ones by example.

        The queries are given by (query, term, weight); cosines of 0 don't count.
        """
        parts = []
        for lo in range(0, n, QUERIES):
            hi = min(n, lo + QUERIES)
            i, j = np.searchsorted(q, (lo, hi))
            a, c, e = self._some(q[i:j] - lo, t[i:j], x[i:j], hi - lo, k, None if without is None else without[lo:hi])
            parts.append((a + lo, c, e))
        return tuple(np.concatenate([p[z] for p in parts]) if parts else np.zeros(0, (np.int64, float, np.int64)[z]) for z in range(3))

    def _some(self, q, t, x, n, k, without):
        row = self.row[t]
        common, rest = row >= 0, row < 0
        query = np.zeros((n, len(self.rows())))
        query[q[common], row[common]] = x[common]
        score = query @ self.rows()
        q, t, x = q[rest], t[rest], x[rest]
        number = self.head[t + 1] - self.head[t]
        h, hq, hx = tk.ranges(self.head[t], number), np.repeat(q, number), np.repeat(x, number)
        pair = hq * self.blocks + self.block[h]
        bound = np.bincount(pair, hx * self.most[h], n * self.blocks).reshape(n, self.blocks) + 0.0
        left = bound > 0
        bound += np.maximum.reduceat(score, np.arange(0, self.size, self.block_size), axis=1)
        own = None if without is None else np.flatnonzero(without >= 0)
        back = np.argsort(self.example) if own is not None else None
        if own is not None:
            score[own, back[without[own]]] = 0
        for wave in (*WAVES, self.blocks):
            if not left.any():
                break
            want = left
            if wave < self.blocks:
                at = np.argpartition(np.where(left, -bound, np.inf), wave - 1, axis=1)[:, :wave]
                want = np.zeros_like(left)
                np.put_along_axis(want, at, True, axis=1)
                want &= left
            some = np.flatnonzero(want.ravel()[pair])
            heads = h[some]
            count = self.first[heads + 1] - self.first[heads]
            p = tk.ranges(self.first[heads], count)
            score += np.bincount(np.repeat(hq[some] * self.size, count) + self.place[p], np.repeat(hx[some], count) * self.x[p], n * self.size).reshape(n, self.size)
            if own is not None:
                score[own, back[without[own]]] = 0
            kth = np.partition(score, self.size - k, axis=1)[:, self.size - k] if self.size > k else np.zeros(n)
            left &= ~want & (bound >= kth[:, None] - 1e-9)
        kth = np.partition(score, self.size - k, axis=1)[:, self.size - k] if self.size > k else np.zeros(n)
        a, b = np.nonzero((score > 0) & (score >= kth[:, None] - 1e-9))
        c, e = np.round(score[a, b], 12), self.example[b]
        by = np.lexsort((e, -c, a))
        a, c, e = a[by], c[by], e[by]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        keep &= c > 0
        return a[keep], c[keep], e[keep]


class Model:
    """Vocabulary, weights, index and calibration."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, hashes: np.ndarray, weight: np.ndarray, telling: dict[int, str], base: float, k: int = K):
        self.ids, self.labels, self.hashes, self.weight, self.telling, self.base, self.k = ids, labels, hashes, weight, telling, base, k
        self.steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
        self.index: Index | None = None

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight) of unit vectors."""
        d, t, n = term_counts(texts, self.hashes)
        x = (1 + np.log(n)) * self.weight[t]
        return d, t, x / np.sqrt(np.bincount(d, x * x, len(texts)))[d] if len(d) else x

    def votes(self, q: np.ndarray, c: np.ndarray, e: np.ndarray, n: int) -> np.ndarray:
        """The weighted share of toxic neighbours; NaN without neighbours."""
        w = 1 / (1 - c + SOFT)
        total = np.bincount(q, w, n)
        return np.where(total > 0, np.bincount(q, w * self.labels[e], n) / np.where(total > 0, total, 1), np.nan)

    def calibrated(self, vote: np.ndarray) -> np.ndarray:
        x, y = self.steps
        score = np.interp(vote, x, y) if len(x) else vote
        return np.where(np.isnan(vote), self.base, score)

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        """(score, telling words, ids of the nearest examples) of each text."""
        n = len(texts)
        if self.index is None:
            return np.full(n, self.base), [""] * n, [""] * n
        d, t, x = self.vectors(texts)
        q, c, e = self.index.nearest(d, t, x, n, self.k)
        cut = np.searchsorted(q, np.arange(n + 1)).tolist()
        ids = self.ids[e].tolist()
        examples = [",".join(map(str, ids[i:j])) for i, j in zip(cut, cut[1:])]
        words: list[list[str]] = [[] for _ in range(n)]
        tell = np.isin(t, np.fromiter(self.telling, np.int64, len(self.telling)))
        for i, k in zip(d[tell].tolist(), t[tell].tolist()):
            words[i].append(self.telling[k])
        return self.calibrated(self.votes(q, c, e, n)), [",".join(sorted(w)) for w in words], examples

    @classmethod
    def fit(cls, ids: list[int], texts: pa.Array, labels: np.ndarray, k: int = K) -> "Model":
        keep = _no_copies(texts)
        texts, labels, ids = texts.take(pa.array(keep)), np.asarray(labels)[keep], np.asarray(ids, np.int64)[keep]
        n, pos = len(labels), int(labels.sum())
        docs, hashes = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
        for at, s in tk.steps(texts):
            w = tk.Words.of(s)
            d, h = tk.set_of(w.doc, w.h)
            docs.append((d + at).astype(np.int32))
            hashes.append(h)
        d, h = np.concatenate(docs), np.concatenate(hashes)
        del docs, hashes
        terms = np.unique(h)
        term = np.searchsorted(terms, h).astype(np.int32)
        del h
        rest = np.ones(n, bool)
        rest[d] = False
        base = float(labels[rest].sum() / (rest.sum() + 2)) if rest.any() else 0.0
        if not len(terms):
            return cls(ids, labels, terms, np.zeros(0), {}, base, k)
        df = np.bincount(term, minlength=len(terms))
        a = np.bincount(term, labels[d], minlength=len(terms))
        del d, term
        expected = df * pos / n
        chi = np.where(a > expected, np.maximum(np.abs(a - expected) - 0.5, 0) ** 2 * n / np.maximum(expected * (n - pos) * (n - df) / n, 1e-9), 0)
        odds = np.log((a + 0.5) / (pos + 1)) - np.log((df - a + 0.5) / (n - pos + 1))
        tie = chi / (chi + HALF) * np.clip(odds, 0, ODDS) / ODDS
        tells = np.flatnonzero(tie >= TELLS)
        telling: dict[int, str] = {}
        for at, s in tk.steps(texts):
            w = tk.Words.of(s)
            for i in np.flatnonzero(np.isin(w.h, terms[tells])).tolist():
                telling.setdefault(int(np.searchsorted(terms, w.h[i])), bytes(w.data[w.start[i] : w.end[i]]).decode())
        m = cls(ids, labels, terms, (np.log((1 + n) / (1 + df)) + 1) * (FLOOR + tie), telling, base, k)
        parts = [((d + at).astype(np.int32), t.astype(np.int32), x) for at, s in tk.steps(texts) for d, t, x in [m.vectors(s)]]
        d, t, x = (np.concatenate([p[i] for p in parts]) for i in range(3))
        del parts
        commonest = np.zeros(n, np.int64)  # of the words of each example: mostly one of its language
        by = np.lexsort((df[t], d))
        commonest[d[by]] = t[by]
        m.index = Index(d, t, x, n, len(terms), np.lexsort((commonest, labels)))
        vote = m.votes(*m.index.nearest(d, t, x, n, k, np.arange(n)), n)
        some = ~np.isnan(vote)
        m.steps = isotonic(vote[some], labels[some].astype(float))
        m.index._rows = None  # made anew where it is used
        return m


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least-squares non-decreasing fit, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for a, b in sorted(zip(x.tolist(), y.tolist())):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            a2, b2, n2 = pools.pop()
            a1, b1, n1 = pools.pop()
            pools.append([(a1 * n1 + a2 * n2) / (n1 + n2), (b1 * n1 + b2 * n2) / (n1 + n2), n1 + n2])
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    pdf = labelled_sample(docs, labels, label, sample, id_col=id_col, text_col=text_col)
    return Model.fit(pdf["id"].tolist(), pa.array(pdf["text"], pa.string()), pdf["y"].to_numpy(np.int64))


def scorer(spark: SparkSession, model: Model, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,words:string,examples:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            parts = [m.judge(s) for _, s in tk.steps(texts)]
            score = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0)
            words, examples = ([x for p in parts for x in p[i]] for i in (1, 2))
            yield pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(words, pa.string()), pa.array(examples, pa.string())], ["score", "words", "examples"])

    return run(text)


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """For every row: doc_id, score (a calibrated probability), the words that told, and the ids of the nearest examples, nearest first."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **how)
    d = take(docs, id_col, text_col).toDF("doc_id", "text")
    return d.select("doc_id", scorer(docs.sparkSession, model, F.col("text")).alias("r")).select("doc_id", "r.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents with their evidence."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).filter(F.col("score") >= LEAST)
