"""Operator 6: language identification of words by a linear-chain conditional random field.

Every word of a text gets a label by forward-backward over the whole text.  `identify`
returns them all as `spans`: runs of words of one label, in the order of the text, each with
its first character and the one after its last, so code-switched text shows where it
switches.  A word's features are its prefixes and suffixes of 1 to 4 bytes, the byte
trigrams inside it and, where the training sample holds it, the word itself; each
feature has a weight for each label, each pair of labels a learned transition
weight.  Training takes a sample, `PER_LABEL` documents of each value of `lang`, and
splices spans of them into `SEQUENCES` code-switched sequences of `LENGTH` words whose
labels are known; the likelihood's gradient comes from the same forward-backward.  What is
labelled is every word of every row.

Forward-backward runs in lockstep over blocks of `BLOCK` words of all texts of a
step: first the product of each block's transfer matrices, then the blocks of a
text one after the other, then the words inside all blocks.  This is exact and
its cost doesn't depend on how long the texts are.

Nulls: a null or empty text, or one without a word, has no language: label null, no spans,
kept false.  Text that mixes languages is kept: what is rejected is text whose words
fit no language.  A null `lang` takes no part in training; a null id is kept as it is.
Without training documents every label is null, there are no spans, words are only counted
and every row is kept.  Ties go to the first label in alphabetical order.  Texts are labelled
whole, however long.  Repeated rows are labelled once for each row, and train as one.  An
empty table gives an empty result; further columns, whatever their names, are left out by
`identify` and kept as they are by `drop_unidentified`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import flat, take

PER_LABEL, SEQUENCES, LENGTH, EPOCHS = 250, 3000, 48, 6
SPACE = 1 << 16
#: Bytes of text labelled at once: their words take some 100 times as much memory.
STEP = 1 << 20
BLOCK = 32
LEAST, MIXED = 0.6, 0.15
_AFFIX = 4


def _codes(w: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, 2 * _AFFIX) affix codes; trigram codes; first trigram of each word (its count is size - 2 or 0)."""
    size = w.end - w.start
    data = w.data
    out = np.empty((len(size), 2 * _AFFIX), np.int64)
    pre = suf = np.zeros(len(size), np.uint64)
    for k in range(_AFFIX):
        have = size > k
        pre = pre * np.uint64(257) + np.where(have, data[np.minimum(w.start + k, w.end - 1)], 0).astype(np.uint64) + np.uint64(1)
        suf = suf * np.uint64(257) + np.where(have, data[np.maximum(w.end - 1 - k, w.start)], 0).astype(np.uint64) + np.uint64(1)
        out[:, 2 * k] = tk.mix(pre + np.uint64(1 + k << 40)) & np.uint64(SPACE - 1)
        out[:, 2 * k + 1] = tk.mix(suf + np.uint64(11 + k << 40)) & np.uint64(SPACE - 1)
    n = np.maximum(size - 2, 0)
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat(w.start - first, n)
    tri = (data[at].astype(np.uint32) << 16) | (data[at + 1].astype(np.uint32) << 8) | data[at + 2]
    return out, ((tri * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), n


class Model:
    """Weights and exact forward-backward."""

    def __init__(self, labels: list[str], lexicon: np.ndarray):
        self.labels, self.lexicon = labels, lexicon  # lexicon: sorted word hashes
        n = len(labels)
        self.affix, self.tri, self.lex = np.zeros((SPACE, n), np.float32), np.zeros((SPACE, n), np.float32), np.zeros((len(lexicon) + 1, n), np.float32)
        self.trans = np.zeros((n, n))

    def words_in_lexicon(self, h: np.ndarray) -> np.ndarray:
        """Place in the lexicon; its length where the word isn't in it."""
        if not len(self.lexicon):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == h, at, len(self.lexicon))

    def emissions(self, w: tk.Words) -> np.ndarray:
        codes, tri, n = _codes(w)
        e = self.lex[self.words_in_lexicon(w.h)]
        for k in range(codes.shape[1]):
            e += self.affix[codes[:, k]]
        if len(tri):
            some = n > 0
            begin = (np.cumsum(n) - n)[some]
            e[some] += np.add.reduceat(self.tri[tri], begin, axis=0) / n[some, None]
        return e

    def posteriors(self, e: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """(words, labels) marginals; `doc` ascends, each run of it is one chain."""
        n, L = e.shape
        if not n:
            return np.zeros((0, L))
        a = np.exp(self.trans - self.trans.max())
        ex = np.exp((e - e.max(axis=1, keepdims=True)).astype(np.float64))
        new = np.r_[True, doc[1:] != doc[:-1]]
        head = np.flatnonzero(new)
        length = np.diff(np.r_[head, n])
        blocks = -(-length // BLOCK)
        chain = np.repeat(np.arange(len(head)), length)
        inside = np.arange(n) - head[chain]
        first_block = np.cumsum(blocks) - blocks
        b, t = first_block[chain] + inside // BLOCK, inside % BLOCK
        nb = int(blocks.sum())
        x = np.ones((BLOCK, nb, L))
        x[t, b] = ex
        used = np.zeros((BLOCK, nb), bool)
        used[t, b] = True
        p = np.broadcast_to(np.eye(L), (nb, L, L)).copy()
        for k in range(BLOCK):
            u = used[k]
            q = (p[u].reshape(-1, L) @ a).reshape(-1, L, L) * x[k, u][:, None, :]
            p[u] = q / q.sum(axis=(1, 2), keepdims=True)
        alpha, beta = np.empty((nb, L)), np.empty((nb, L))
        order = np.argsort(-blocks, kind="stable")
        at, sizes = first_block[order], blocks[order]
        v = np.full((len(head), L), 1.0 / L)
        for j in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -j, "left"))
            alpha[at[:live] + j] = v[:live]
            v = np.einsum("nl,nlm->nm", v[:live], p[at[:live] + j])
            v /= v.sum(axis=1, keepdims=True)
        v = np.ones((len(head), L))
        for j in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -j, "left"))
            last = at[:live] + sizes[:live] - 1 - j
            beta[last] = v[:live]
            v = np.einsum("nlm,nm->nl", p[last], v[:live])
            v /= v.sum(axis=1, keepdims=True)
        forward = np.empty((BLOCK, nb, L))
        for k in range(BLOCK):
            u = used[k][:, None]
            q = (alpha @ a) * x[k]
            alpha = np.where(u, q / q.sum(axis=1, keepdims=True), alpha)
            forward[k] = alpha
        self._beta = np.empty((BLOCK, nb, L))
        for k in range(BLOCK - 1, -1, -1):
            self._beta[k] = beta
            u = used[k][:, None]
            q = (x[k] * beta) @ a.T
            beta = np.where(u, q / q.sum(axis=1, keepdims=True), beta)
        g = forward[t, b] * self._beta[t, b]
        del self._beta
        return g / g.sum(axis=1, keepdims=True)

    def train(self, e_parts: tuple, y: np.ndarray, epochs: int, rate: float = 0.5) -> None:
        """Adagrad ascent of the log-likelihood over sequences of LENGTH words; y: (sequences, LENGTH)."""
        lex, codes, tri, tri_of, n = e_parts
        L, (S, T) = len(self.labels), y.shape
        sums = [np.full_like(m, 1e-6, dtype=np.float64) for m in (self.lex, self.affix, self.tri, self.trans)]
        rng = np.random.default_rng(7)
        tri_cut = np.r_[0, np.cumsum(n)]
        for _ in range(epochs):
            for pick in np.array_split(rng.permutation(S), max(1, S // 250)):
                word = (pick[:, None] * T + np.arange(T)).ravel()
                tn = n[word]
                tw = np.repeat(np.arange(len(word)), tn)
                ti = tri[np.arange(int(tn.sum())) + np.repeat(tri_cut[word] - (np.cumsum(tn) - tn), tn)]
                share = (1.0 / np.maximum(tn, 1))[tw]
                e = self.lex[lex[word]].astype(np.float64)
                for k in range(codes.shape[1]):
                    e += self.affix[codes[word, k]]
                for c in range(L):
                    e[:, c] += np.bincount(tw, self.tri[ti, c] * share, minlength=len(word))
                x = np.exp(e - e.max(axis=1, keepdims=True)).reshape(len(pick), T, L)
                a = np.exp(self.trans)
                al, be = np.empty_like(x), np.empty_like(x)
                v = np.full((len(pick), L), 1.0 / L)
                before = []
                for t in range(T):
                    before.append(v)
                    v = (v @ a) * x[:, t]
                    v /= v.sum(axis=1, keepdims=True)
                    al[:, t] = v
                v = np.ones((len(pick), L))
                want = np.zeros((L, L))
                for t in range(T - 1, -1, -1):
                    be[:, t] = v
                    z = before[t][:, :, None] * a * (x[:, t] * v)[:, None, :]
                    z /= z.sum(axis=(1, 2), keepdims=True)
                    want += z.sum(axis=0)
                    if t == 0:  # the start label is hidden and uniform
                        want -= z.sum(axis=0)
                    v = (x[:, t] * v) @ a.T
                    v /= v.sum(axis=1, keepdims=True)
                g = al * be
                g = (g / g.sum(axis=2, keepdims=True)).reshape(-1, L)
                yy = y[pick]
                d = -g
                d[np.arange(len(d)), yy.ravel()] += 1
                have = np.bincount((yy[:, :-1] * L + yy[:, 1:]).ravel(), minlength=L * L).reshape(L, L)
                grads = [np.zeros_like(s) for s in sums]
                for c in range(L):
                    grads[0][:, c] = np.bincount(lex[word], d[:, c], minlength=len(self.lex))
                    grads[1][:, c] = np.bincount(codes[word].ravel(), np.repeat(d[:, c], codes.shape[1]), minlength=SPACE)
                    grads[2][:, c] = np.bincount(ti, d[tw, c] * share, minlength=SPACE)
                grads[3][:] = have - want
                for m, s, gr in zip((self.lex, self.affix, self.tri, self.trans), sums, grads):
                    gr /= len(pick)
                    s += gr * gr
                    m += (rate * gr / np.sqrt(s)).astype(m.dtype)

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], sequences: int = SEQUENCES, epochs: int = EPOCHS) -> "Model | None":
        """Splices spans of the texts into sequences; None without a text that has a word."""
        w = tk.Words.of(pa.array(texts, pa.string()))
        labels = sorted(set(langs))
        if not len(w.h):
            return None
        m = cls(labels, np.unique(w.h))
        codes, tri, n = _codes(w)
        lex = m.words_in_lexicon(w.h)
        size = w.counts()
        head = np.cumsum(size) - size
        lang = np.array([labels.index(x) for x in langs])
        by = [np.flatnonzero((lang == c) & (size > 0)) for c in range(len(labels))]
        by = [x if len(x) else None for x in by]
        able = [c for c in range(len(labels)) if by[c] is not None]
        rng = np.random.default_rng(11)
        index, y = np.empty((sequences, LENGTH), np.int64), np.empty((sequences, LENGTH), np.int64)
        for s in range(sequences):
            at, pure = 0, rng.random() < 0.5
            c = able[rng.integers(len(able))]
            while at < LENGTH:
                d = by[c][rng.integers(len(by[c]))]
                span = min(LENGTH - at, int(rng.integers(3, 25)) if not pure else LENGTH, int(size[d]))
                start = head[d] + rng.integers(size[d] - span + 1)
                index[s, at : at + span] = np.arange(start, start + span)
                y[s, at : at + span] = c
                at += span
                if not pure:
                    c = able[rng.integers(len(able))]
        flat_index = index.ravel()
        cut = np.r_[0, np.cumsum(n)]
        tn = n[flat_index]
        tri_at = np.arange(int(tn.sum())) + np.repeat(cut[flat_index] - (np.cumsum(tn) - tn), tn)
        m.train((lex[flat_index], codes[flat_index], tri[tri_at], None, tn), y, epochs)
        return m

    def spans(self, w: tk.Words, g: np.ndarray) -> pa.Array:
        """For each text the runs of words whose likeliest label is the same; together they hold every word."""
        tag = g.argmax(axis=1)
        new = np.ones(len(tag), bool)
        new[1:] = (tag[1:] != tag[:-1]) | (w.doc[1:] != w.doc[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(tag)])
        # lower case keeps the number of characters, not that of bytes
        chars = np.r_[0, np.cumsum((w.data & 0xC0) != 0x80)]
        zero = chars[w.offsets[w.doc[first]]]
        sure = np.add.reduceat(g.max(axis=1), first) / size if len(first) else np.zeros(0)
        cols = [chars[w.start[first]] - zero, chars[w.end[first + size - 1]] - zero, tag[first], size, sure]
        items = pa.StructArray.from_arrays([pa.array(cols[0].astype(np.int32)), pa.array(cols[1].astype(np.int32)), pa.array(self.labels, pa.string()).take(pa.array(cols[2])), pa.array(cols[3].astype(np.int32)), pa.array(cols[4])], ["start", "end", "label", "n_words", "certainty"])
        return pa.ListArray.from_arrays(np.r_[0, np.cumsum(np.bincount(w.doc[first], minlength=w.n_docs))].astype(np.int32), items)

    def label(self, texts: pa.Array, spans: bool = False) -> dict[str, np.ndarray | pa.Array]:
        """Columns of the result, for each text."""
        w = tk.Words.of(texts)
        g = self.posteriors(self.emissions(w), w.doc)
        n, L = w.counts(), len(self.labels)
        share = np.stack([np.bincount(w.doc, g[:, c], minlength=w.n_docs) for c in range(L)], axis=1) / np.maximum(n, 1)[:, None]
        tag = g.argmax(axis=1)
        switch = (tag[1:] != tag[:-1]) & (w.doc[1:] == w.doc[:-1])
        best = share.argmax(axis=1)
        order = np.sort(share, axis=1)
        sure = np.bincount(w.doc, g.max(axis=1), minlength=w.n_docs) / np.maximum(n, 1)
        r = {"label": best, "share": order[:, -1], "certainty": sure, "second": order[:, -2] if L > 1 else np.zeros(len(n)), "n_words": n, "n_switches": np.bincount(w.doc[1:][switch], minlength=w.n_docs)}
        return r | ({"spans": self.spans(w, g)} if spans else {})


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", per_label: int = PER_LABEL, **how) -> Model | None:
    """A model of `per_label` documents of each label, taken in the order of a hash of the text."""
    d = take(docs, text_col, lang_col).toDF("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    d = d.withColumn("h", F.xxhash64("text"))
    # the least hashes of each label, found before any text moves
    least = d.select("lang", "h").distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= per_label).select("lang", "h")
    # one row for each hash, so that copies don't gather on the driver
    pdf = d.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).toPandas().sort_values(["lang", "h"])
    return Model.fit(pdf["text"].tolist(), pdf["lang"].astype(str).tolist(), **how)


_RESULT = "label:string,share:double,certainty:double,second:double,n_words:long,n_switches:long"
_SPANS = "array<struct<start:int,end:int,label:string,n_words:int,certainty:double>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("n_words", pa.int32()), ("certainty", pa.float64())]))


def labeller(spark: SparkSession, model: Model | None, text: Column, spans: bool = False) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<{_RESULT}{',spans:' + _SPANS if spans else ''}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            cols, runs = {k: [] for k in ("label", "share", "certainty", "second", "n_words", "n_switches")}, []
            for _, s in tk.steps(texts, STEP):
                r = m.label(s, spans) if m else {k: np.zeros(len(s), np.int64) for k in cols} | {"n_words": tk.Words.of(s).counts()}
                for k in cols:
                    cols[k].append(r[k])
                if spans:
                    runs.append(r["spans"] if m else pa.array([[]] * len(s), _SPAN))
            got = {k: np.concatenate(v) if v else np.zeros(0) for k, v in cols.items()}
            none = (got["n_words"] == 0) | (m is None)
            names = pa.array(m.labels if m else [""], pa.string())
            label = names.take(pa.array(np.where(none, -1, got["label"]).astype(np.int64), mask=none))
            arrays = [label, pa.array(got["share"].astype(float), mask=none), pa.array(got["certainty"].astype(float), mask=none), pa.array(got["second"].astype(float), mask=none), pa.array(got["n_words"].astype(np.int64)), pa.array(got["n_switches"].astype(np.int64))]
            if spans:
                arrays.append(pa.concat_arrays(runs) if runs else pa.array([], _SPAN))
            yield pa.StructArray.from_arrays(arrays, [*cols, *["spans"] * spans])
        tk.release()

    return run(text)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST, mixed: float = MIXED, **how) -> DataFrame:
    """For every row: doc_id, label, its share of the words, the mean certainty of the words' labels, n_words, n_switches, the spans of the words' labels (start and end in characters, label, n_words, mean certainty), whether a second language has a share of at least `mixed`, and kept."""
    model = fit(docs, text_col=text_col, lang_col=lang_col, **how)
    d = take(docs, id_col, text_col).toDF("doc_id", "text")
    r = d.select("doc_id", labeller(docs.sparkSession, model, F.col("text"), spans=True).alias("r"))
    kept = F.coalesce(F.col("r.certainty") >= least, F.lit(False)) if model else F.lit(True)
    return r.select("doc_id", "r.label", "r.share", "r.certainty", "r.n_words", "r.n_switches", "r.spans", F.coalesce(F.col("r.second") >= mixed, F.lit(False)).alias("code_switched"), kept.alias("kept"))


def drop_unidentified(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: float = LEAST, **how) -> DataFrame:
    """`docs` without the rows that have no language, or whose words have a mean certainty under `least`."""
    model = fit(docs, text_col=text_col, lang_col=lang_col, **how)
    if model is None:
        return docs
    table, names = flat(docs)
    r = labeller(docs.sparkSession, model, F.col(f"c{names.index(text_col)}"))
    return table.filter(F.coalesce(r["certainty"] >= least, F.lit(False))).toDF(*names)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language and those of its words; `kept` says whether they fit one."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
