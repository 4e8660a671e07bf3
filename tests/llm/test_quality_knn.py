import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import quality_knn as qk
from sparkloom.llm import textkit as tk

from .conftest import PROSE


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = PROSE[sorted(PROSE)[i % 3]].split()
        good = i % 2 == 0
        t = " ".join(rng.choice(words, int(rng.integers(20, 60))))
        if not good:
            t = [" ".join(rng.choice(list("#$%|<>=0123456789"), 80)), ("buy now " * 30), t.upper() + "!!!"][i % 3]
        out.append((t, int(good)))
    return out


def test_votes_equal_brute_force():
    c = corpus(200, 1)
    m = qk.Model.fit(pa.array([t for t, _ in c]), np.array([y for _, y in c]), k=7)
    texts = pa.array([t for t, _ in corpus(60, 2)])
    v, ok = m.vectors_of(texts)
    score, _ = m.score(texts, block=16)
    sim = np.round(v @ m.vectors.T, qk.DIGITS)
    for i in range(60):
        near = np.argsort(-sim[i], kind="stable")[:7]
        w = np.maximum(sim[i][near], 0)
        assert abs(score[i] - (w * m.labels[near]).sum() / w.sum()) < 1e-4
    assert ok.all()


def test_ties_go_to_the_lesser_position():
    rng = np.random.default_rng(1)
    sim = rng.integers(0, 6, (300, 40)).astype(np.float32) / 5
    for k in (1, 5, 39, 40):
        got = qk.nearest(sim, k)
        want = np.sort(np.argsort(-sim, axis=1, kind="stable")[:, :k], axis=1)
        assert (np.sort(got, axis=1) == want).all()
    texts = pa.array(["one two three"] * 4 + ["some other words"] * 4)
    m = qk.Model.fit(texts, np.array([1, 1, 0, 0, 0, 0, 0, 0]), k=2)
    assert m.score(texts.slice(0, 2))[0].tolist() == [1.0, 1.0]  # the first two of four equal ones


def test_words_are_among_the_terms():
    texts = pa.array(["alpha beta", "alpha gamma", "alpha beta delta"])
    words = qk.widespread(texts, 2)
    assert set(words.tolist()) == {tk.hash_word("alpha"), tk.hash_word("beta")}
    assert sorted(qk.counts(texts, words)[:, qk.TERMS :].sum(axis=0).tolist()) == [2, 3]
    x = np.random.default_rng(0).normal(size=(60, 30)).astype(np.float32)
    x[:, :3] *= 20
    axes = qk.axes_of(x, 3)
    want = np.linalg.svd(x, full_matrices=False)[2][:3].T
    assert np.allclose(np.abs(axes.T @ want), np.eye(3), atol=1e-3)


def test_very_long_and_repeated_texts(spark, table):
    c = corpus(60, 7)
    long_ = (PROSE["en"] + "\n") * 40_000
    df = table([*[(i, t) for i, (t, _) in enumerate(c)], (100, long_), (101, c[0][0]), (101, c[0][0])])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(c)], "doc_id long, quality int")
    by = [(r.doc_id, r.score) for r in qk.classify(df, labels).collect()]
    score = dict(by)
    assert len(by) == 63 and score[100] > 0.5 and [s for i, s in by if i == 101] == [score[0]] * 2


def test_held_out():
    c, d = corpus(400, 3), corpus(200, 4)
    m = qk.Model.fit(pa.array([t for t, _ in c]), np.array([y for _, y in c]))
    score, _ = m.score(pa.array([t for t, _ in d]))
    assert sum((s >= qk.LEAST) == bool(y) for s, (_, y) in zip(score, d)) >= 190


def test_table(spark, table, odd_rows):
    c = corpus(200, 5)
    df = table([*[(100 + i, t) for i, (t, _) in enumerate(c)], *odd_rows])
    labels = spark.createDataFrame([*[(100 + i, y) for i, (_, y) in enumerate(c)], (None, 1), (100, None)], "doc_id long, quality int")
    by = {r.doc_id: r for r in qk.classify(df, labels).collect()}
    assert by[1].score is None and by[1].kept and by[2].score is None and by[2].kept
    kept = qk.drop_low_quality(df, labels)
    assert kept.columns == df.columns
    ids = [r[0] for r in kept.collect()]
    assert ids.count(4) == 2 and {1, 2, 3, 6, 9, None} <= set(ids)
    assert sum((100 + i in ids) == bool(y) for i, (_, y) in enumerate(c)) >= 192
    assert qk.drop_low_quality(df, labels.limit(0)).count() == df.count()
    assert qk.drop_low_quality(df.limit(0), labels).count() == 0


def test_ids_must_be_whole_numbers(spark):
    docs = spark.createDataFrame([("b2", "some words")], "doc_id string, text string")
    with pytest.raises(ValueError, match="whole numbers"):
        qk.classify(docs, docs.selectExpr("doc_id", "1 AS quality"))
