import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import toxicity_knn as tx


@pytest.mark.parametrize(("block", "often", "waves"), [(16, 16, (2, 5)), (64, 3, (1,)), (7, 10**6, (1, 2))])
def test_index_is_exact(monkeypatch, block, often, waves):
    monkeypatch.setattr(tx, "OFTEN", often)
    monkeypatch.setattr(tx, "WAVES", waves)
    rng = np.random.default_rng(2)
    dense = rng.random((300, 40)) * (rng.random((300, 40)) < np.linspace(0.01, 0.4, 40))
    dense[50:60] = dense[0]  # ties
    dense[7] = 0
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    d, t = np.nonzero(dense)
    index = tx.Index(d, t, dense[d, t], 300, 40, rng.permutation(300), block=block)
    s = np.round(dense @ dense.T, 12)
    for k, without in ((7, None), (7, np.arange(300)), (400, None)):
        q, c, e = index.nearest(d, t, dense[d, t], 300, k, without)
        for i in range(300):
            want = sorted((-x, j) for j, x in enumerate(s[i]) if x > 0 and (without is None or j != i))[:k]
            got = [(-x, j) for x, j in zip(c[q == i], e[q == i].tolist())]
            assert [j for _, j in got] == [j for _, j in want] and np.allclose([x for x, _ in got], [x for x, _ in want])
    assert [len(x) for x in index.nearest(d[:0], t[:0], d[:0] * 1.0, 0, 3)] == [0, 0, 0]


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    bad = ["vile", "scum", "filth", "trash"]
    texts, y = [], []
    for i in range(n):
        t = rng.choice(words, 40).tolist()
        toxic = i % 4 == 0
        if toxic:
            for b in rng.choice(bad, 3):
                t.insert(int(rng.integers(len(t))), b)
        texts.append(" ".join(t))
        y.append(int(toxic))
    return texts, y


def test_held_out():
    texts, y = corpus(800, 1)
    m = tx.Model.fit(list(range(800)), pa.array(texts), np.array(y))
    texts2, y2 = corpus(200, 2)
    score = m.judge(pa.array(texts2))[0]
    assert ((score >= 0.5) == np.array(y2, bool)).sum() >= 195
    # every word is in the vocabulary, and neighbours and votes are those of brute force
    assert len(m.hashes) == len({w for t in texts for w in t.split()})
    d, t, x = m.vectors(pa.array(texts))
    dense = np.zeros((800, len(m.hashes)))
    kept = tx._no_copies(pa.array(texts))
    dense[d, t] = x
    q = np.zeros((200, len(m.hashes)))
    d, t, x = m.vectors(pa.array(texts2))
    q[d, t] = x
    s = np.round(q @ dense[kept].T, 12)
    near = np.argsort(-s, axis=1, kind="stable")[:, : tx.K]
    w = 1 / (1 - np.take_along_axis(s, near, 1) + tx.SOFT)
    vote = (w * np.array(y)[kept][near]).sum(axis=1) / w.sum(axis=1)
    assert np.allclose(score, m.calibrated(vote))


def test_labels_of_one_kind_and_texts_without_words():
    texts = pa.array(["one two three four", "five six seven eight", "!!", ""])
    for y, want in (([1, 1, 1, 1], [1.0, 0.5]), ([0, 0, 0, 0], [0.0, 0.0])):
        m = tx.Model.fit([4, 3, 2, 1], texts, np.array(y))
        assert m.judge(pa.array(["two", "nine", None]))[0].tolist() == [want[0], want[1], want[1]]
    m = tx.Model.fit([], texts.slice(0, 0), np.zeros(0, int))
    assert m.judge(texts)[0].tolist() == [0.0] * 4


def test_ties_and_repeated_texts():
    texts = ["same words here", "other words there", "same things here"]
    m = tx.Model.fit([10, 20, 30], pa.array(texts), np.array([1, 0, 0]), k=1)
    # "words": two examples at one cosine; the first of the sample wins, twice
    assert m.judge(pa.array(["words", "words"]))[2] == ["10", "10"]


def test_table(spark, table, odd_rows):
    texts, y = corpus(400, 3)
    df = table([*[(100 + i, t) for i, t in enumerate(texts)], *odd_rows])
    labels = spark.createDataFrame([*[(100 + i, v, 1) for i, v in enumerate(y)], (None, 1, 1), (101, None, 1), (3, 0, 0)], "doc_id long, toxic int, y int")
    rows = tx.score(df, labels).collect()
    assert len(rows) == 400 + len(odd_rows)
    by = {r.doc_id: r for r in rows}
    assert all((by[100 + i].score >= 0.5) == bool(v) for i, v in enumerate(y))
    assert by[1].words == by[2].words == by[2].examples == "" and by[1].score == by[2].score < 0.5
    assert by[100].words and by[100].examples
    assert tx.score(df.limit(0), labels).collect() == []
    assert {r.score for r in tx.score(df, labels.limit(0)).collect()} == {0.0}


def test_ids_must_be_whole_numbers(spark):
    docs = spark.createDataFrame([("b2", "some words")], "doc_id string, text string")
    with pytest.raises(ValueError, match="whole numbers"):
        tx.score(docs, docs.selectExpr("doc_id", "1 AS toxic"))
