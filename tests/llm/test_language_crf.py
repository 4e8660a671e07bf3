import itertools
import re

import numpy as np
import pyarrow as pa

from sparkloom.llm import language_crf as lc

from .conftest import PROSE


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    m = lc.Model(["a", "b", "c"], np.zeros(0, np.uint64))
    m.trans = rng.normal(size=(3, 3))
    sizes = [1, 2, 5, 7]
    e = rng.normal(size=(sum(sizes), 3)).astype(np.float32)
    doc = np.repeat([0, 2, 3, 9], sizes)
    got, at = m.posteriors(e, doc), 0
    for n in sizes:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            # the hidden start label is uniform
            s = np.exp(sum(e[at + k, c] for k, c in enumerate(path)) + sum(m.trans[a, b] for a, b in zip(path, path[1:])))
            s *= np.exp(m.trans[:, path[0]]).sum()
            for k, c in enumerate(path):
                want[k, c] += s
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True), atol=1e-6)
        at += n


def test_blocks_do_not_matter():
    rng = np.random.default_rng(2)
    m = lc.Model(["a", "b"], np.zeros(0, np.uint64))
    m.trans = rng.normal(size=(2, 2))
    n = 5 * lc.BLOCK + 3
    e = rng.normal(size=(n, 2))
    a, x = np.exp(m.trans), np.exp(e)
    f, b = np.empty((n, 2)), np.empty((n, 2))
    v = np.ones(2)
    for k in range(n):
        v = (v @ a) * x[k]
        v /= v.sum()
        f[k] = v
    v = np.ones(2)
    for k in range(n - 1, -1, -1):
        b[k] = v
        v = (x[k] * v) @ a.T
        v /= v.sum()
    want = f * b
    assert np.allclose(m.posteriors(e, np.zeros(n, int)), want / want.sum(axis=1, keepdims=True))


def _texts(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = sorted(PROSE)[i % 3]
        words = PROSE[lang].split()
        out.append((" ".join(rng.choice(words, 12)), lang))
    return out


def test_held_out_and_code_switched():
    train = _texts(240, 1)
    m = lc.Model.fit([t for t, _ in train], [x for _, x in train], sequences=500, epochs=4)
    test = _texts(90, 2)
    r = m.label(pa.array([t for t, _ in test]))
    assert sum(m.labels[c] == x for c, (_, x) in zip(r["label"], test)) >= 88
    r = m.label(pa.array([PROSE["en"] + " " + PROSE["de"]]))
    assert r["n_switches"][0] >= 1 and r["second"][0] > 0.3


def test_table(spark, table, odd_rows):
    train = [(100 + i, t, x) for i, (t, x) in enumerate(_texts(150, 3))]
    df = table([*train, *odd_rows])
    how = {"sequences": 300, "epochs": 3}
    rows = lc.identify(df, **how).collect()
    assert len(rows) == 150 + len(odd_rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].label is None and not by[1].kept and by[2].label is None and not by[2].kept and not by[7].kept
    assert by[3].label == "en" and by[9].label == "fr" and by[4].label == "de"
    kept = lc.drop_unidentified(df, **how)
    assert kept.columns == df.columns
    ids = [r[0] for r in kept.collect()]
    assert not {1, 2, 7} & set(ids) and {3, 4, 5, 6, 9, None} <= set(ids) and ids.count(4) == 2
    assert lc.identify(df.limit(0)).collect() == []
    untrained = df.withColumn("lang", df["key"].cast("string").substr(9, 1)).replace("", None, ["lang"])
    assert lc.drop_unidentified(untrained).count() == df.count()


def test_spans_hold_every_word():
    train = _texts(240, 1)
    m = lc.Model.fit([t for t, _ in train], [x for _, x in train], sequences=500, epochs=4)
    # İ and Ⱥ have another number of bytes in lower case
    texts = ["İ Ⱥ 😀 é, " + PROSE["en"] + "! " + PROSE["de"], None, "", "?! .", PROSE["fr"].upper(), (PROSE["de"] + ". " + PROSE["fr"] + "\n") * 40, "the"]
    r = m.label(pa.array(texts), spans=True)
    w = lc.tk.Words.of(pa.array(texts))
    tag = m.posteriors(m.emissions(w), w.doc).argmax(axis=1)
    for k, (text, spans) in enumerate(zip(texts, r["spans"].to_pylist())):
        words = list(re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or ""))
        got = [next(s["label"] for s in spans if s["start"] <= x.start() and x.end() <= s["end"]) for x in words]
        assert got == [m.labels[c] for c in tag[w.doc == k]]
        assert len(spans) == (r["n_switches"][k] + 1 if words else 0) and sum(s["n_words"] for s in spans) == r["n_words"][k] == len(words)
        assert all(a["label"] != b["label"] and a["end"] < b["start"] for a, b in zip(spans, spans[1:]))
        assert not spans or (spans[0]["start"], spans[-1]["end"]) == (words[0].start(), words[-1].end())
    last = r["spans"].to_pylist()[0][-1]
    assert last["label"] == "de" and abs(last["start"] - texts[0].index(PROSE["de"])) < 10 and last["certainty"] > 0.6


def test_lexicon_has_every_word_of_the_sample():
    words = [f"w{i}x" for i in range(6000)]
    m = lc.Model.fit([" ".join(words[:3000]), " ".join(words[3000:])], ["a", "b"], sequences=10, epochs=1)
    assert (m.words_in_lexicon(lc.tk.Words.of(pa.array(words)).h) < len(m.lexicon)).all()


def test_query_gives_every_row_and_the_labels_of_its_words(spark, odd_rows, tmp_path):
    mixed = PROSE["en"] + " " + PROSE["de"]
    rows = [*((100 + i, t, x) for i, (t, x) in enumerate(_texts(150, 3))), *(x[:3] for x in odd_rows), (50, mixed, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lc.op6(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    by = {r.doc_id: r for r in got}
    assert all(sum(s.n_words for s in r.spans) == r.n_words and len(r.spans) == r.n_switches + (r.n_words > 0) for r in got)
    assert all(not by[k].kept and by[k].label is None and by[k].spans == [] for k in (1, 2, 7)) and by[3].kept and by[3].n_words == 20_000 * len(PROSE["en"].split())
    assert [s.label for s in by[50].spans] == ["en", "de"] and by[50].code_switched
    # without training documents there are no labels
    spark.createDataFrame([(*x[:2], None) for x in rows[:5]], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/none/documents.parquet")
    got = lc.op6(spark, f"{tmp_path}/none").collect()
    assert len(got) == 5 and all(r.label is None and r.share is None and r.spans == [] and r.n_words == 12 and r.kept for r in got)
