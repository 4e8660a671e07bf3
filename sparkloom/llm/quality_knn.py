"""Operator 7: quality by nearest-neighbour voting over latent-semantic vectors.

Terms are the `WORDS` words that most documents of the sample hold, and what separates
prose from junk in any language: pairs of adjacent character classes, word lengths and
words that repeat the one before.  A bounded sample of labelled documents (`SAMPLE` rows)
gives the words, the inverse document frequencies (those of words times `SHARE`, so that
topics don't outweigh form) and, by a singular value decomposition
(subspace iteration), `DIMS` latent axes.  The sample's unit vectors are broadcast
(SAMPLE x DIMS floats, whatever the size of the table); every document is multiplied with
all of them in blocks, exactly, and its `K` nearest vote with their cosine as weight.

Ids are whole numbers; a column of another type is refused by `fit`.  Nulls: a null text,
or one without any term, has no vector: score null, kept true (nothing speaks against
it).  Rows with null ids or texts, and labels other than 0 and 1, don't take part in the
sample.  Without any labelled document every score is null.  Ties: cosines are compared
to `DIGITS` digits; equal ones go to the lesser sample position (the lesser id).  Texts
are read whole, however long.  Repeated rows are scored once for each row.  An empty
table gives an empty result; further columns, whatever their names, are left out by
`classify` and kept as they are by `drop_low_quality`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import flat, labelled_sample, take

SAMPLE, DIMS, K, LEAST, WORDS, SHARE, DIGITS = 4096, 32, 15, 0.5, 2048, 0.5, 5

_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.zeros(256, np.int32)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[ord(" ")] = 4
_CLASS[ord("\n")] = 5
for _i, _c in enumerate(_PUNCT):
    _CLASS[_c] = 6 + _i
_CLASS[128:] = 6 + len(_PUNCT)
_N = 7 + len(_PUNCT)
_LENGTHS = 24
#: Bytes of text counted at once: the counts take some 8 KB a text.
STEP = 1 << 19
#: Class pairs, word lengths, repeated words; known words follow.
TERMS = _N * _N + _LENGTHS + 1


def counts(texts: pa.Array, words: np.ndarray) -> np.ndarray:
    """(texts, TERMS + words) term counts; words: sorted hashes."""
    w = tk.Words.of(texts, lower=False)
    n, out = w.n_docs, np.zeros((w.n_docs, TERMS + len(words)), np.float32)
    if len(w.data) > 1:
        cls = _CLASS[w.data]
        doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(w.offsets))
        code = cls[:-1] * _N + cls[1:] + doc[:-1] * (_N * _N)
        inside = doc[:-1] == doc[1:]
        out[:, : _N * _N] = np.bincount(code if inside.all() else code[inside], minlength=n * _N * _N).reshape(n, -1)
    if len(w.h):
        size = np.minimum(w.end - w.start, _LENGTHS) - 1
        out[:, _N * _N : TERMS - 1] = np.bincount(w.doc * _LENGTHS + size, minlength=n * _LENGTHS).reshape(n, -1)
        again = (w.h[1:] == w.h[:-1]) & (w.doc[1:] == w.doc[:-1])
        out[:, TERMS - 1] = np.bincount(w.doc[1:][again], minlength=n)
        if len(words):
            at = np.minimum(np.searchsorted(words, w.h), len(words) - 1)
            hit = words[at] == w.h
            out[:, TERMS:] = np.bincount(w.doc[hit] * len(words) + at[hit], minlength=n * len(words)).reshape(n, -1)
    return out


def widespread(texts: pa.Array, most: int) -> np.ndarray:
    """The sorted hashes of the `most` words that most texts hold; of equally many the least hashes."""
    seen = [tk.set_of(w.doc, w.h)[1] for _, s in tk.steps(texts) for w in [tk.Words.of(s, lower=False)]]
    h, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *seen]), return_counts=True)
    return np.sort(h[np.argsort(-df, kind="stable")[:most]])


def axes_of(x: np.ndarray, dims: int) -> np.ndarray:
    """The first right singular vectors of the rows, by subspace iteration from a fixed start."""
    k = min(dims, *x.shape)
    y = np.random.default_rng(5).normal(size=(x.shape[1], min(k + 16, *x.shape))).astype(np.float32)
    for _ in range(8):
        y = np.linalg.qr(x.T @ (x @ y))[0]
    return y @ np.linalg.svd(x @ y, full_matrices=False)[2][:k].T


def nearest(sim: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) places of the greatest values of each row; equal ones by place."""
    kth = np.partition(sim, sim.shape[1] - k, axis=1)[:, -k, None]
    want = sim >= kth
    for i in np.flatnonzero(want.sum(axis=1) > k):  # several hold the k-th value
        want[i, np.flatnonzero(sim[i] == kth[i])[k - int((sim[i] > kth[i]).sum()) :]] = False
    return np.nonzero(want)[1].reshape(len(sim), k)


class Model:
    """Terms, projection and labelled vectors; `score` gives the votes of documents."""

    def __init__(self, words: np.ndarray, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int = K):
        self.words, self.project, self.vectors, self.labels, self.k = words, (idf[:, None] * axes).astype(np.float32), vectors, labels, k

    @classmethod
    def fit(cls, texts: pa.Array, labels: np.ndarray, dims: int = DIMS, k: int = K, most: int = WORDS) -> "Model | None":
        if not len(texts):
            return None
        words = widespread(texts, most)
        c = np.concatenate([counts(s, words) for _, s in tk.steps(texts, STEP)])
        some = c.any(axis=1)
        c, labels = np.sqrt(c[some]), labels[some]
        if not len(c):
            return None
        idf = 1 + np.log(len(c) / np.maximum(1, (c > 0).sum(axis=0))).astype(np.float32)
        idf[TERMS:] *= SHARE
        x = c * idf
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        axes = axes_of(x, dims)
        v = (x @ axes).astype(np.float32)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return cls(words, idf, axes, v, labels.astype(np.float32), k)

    def vectors_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        c = counts(texts, self.words)
        v = np.sqrt(c) @ self.project
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.maximum(size, 1e-12), c.any(axis=1) & (size[:, 0] > 1e-12)

    def score(self, texts: pa.Array, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(share of the votes that is for quality, whether the text has a vector)."""
        v, ok = self.vectors_of(texts)
        out, k = np.zeros(len(v)), min(self.k, len(self.vectors))
        for at in range(0, len(v), block):
            sim = v[at : at + block] @ self.vectors.T
            np.round(sim, DIGITS, out=sim)
            near = nearest(sim, k)
            weight = np.maximum(np.take_along_axis(sim, near, 1).astype(np.float64), 0)
            out[at : at + block] = (weight * self.labels[near]).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-12)
        return out, ok


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model of at most `sample` labelled documents; None where there is none."""
    pdf = labelled_sample(docs, labels, label, sample, id_col=id_col, text_col=text_col)
    return Model.fit(pa.array(pdf["text"], pa.string()), pdf["y"].to_numpy(np.float32))


def scorer(spark: SparkSession, model: Model | None, text: Column) -> Column:
    """The score of a text column, null where there is none."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            parts = [m.score(s) if m else (np.zeros(len(s)), np.zeros(len(s), bool)) for _, s in tk.steps(texts, STEP)]
            score, ok = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in (0, 1))
            yield pc.if_else(pa.array(np.asarray(ok, bool)), pa.array(np.asarray(score, np.float64)), pa.scalar(None, pa.float64()))
        tk.release()

    return run(text)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, **how) -> DataFrame:
    """doc_id, score and kept for every row."""
    spark = docs.sparkSession
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **how)
    d = take(docs, id_col, text_col).toDF("doc_id", "text")
    scored = d.select("doc_id", scorer(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("kept", F.coalesce(F.col("score") >= least, F.lit(True)))


def drop_low_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, **how) -> DataFrame:
    """`docs` without the rows whose score is under `least`."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **how)
    table, names = flat(docs)
    score = scorer(docs.sparkSession, model, F.col(f"c{names.index(text_col)}"))
    return table.filter(F.coalesce(score >= least, F.lit(True))).toDF(*names)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass, with their scores."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept").drop("kept")
