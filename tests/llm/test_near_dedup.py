import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import near_dedup as nd
from sparkloom.llm import textkit as tk


def shingles(text):
    import re

    w = re.findall(tk.WORD_PATTERN, text.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def test_signature_is_circulant():
    d, h = tk.Words.of(pa.array(["a b c d e f", "", "x y z w"])).shingles(3)
    docs, sig = nd.signatures(d, h, 12)
    sigma, rows = nd.permutations(12)
    pi = rows[:, 0]
    assert docs.tolist() == [0, 2]
    for k, doc in enumerate(docs):
        slots = sigma[(h[d == doc] & np.uint64(nd.DOMAIN - 1)).astype(np.int64)].astype(np.int64)
        assert [int(pi[(slots + s) % nd.DOMAIN].min()) for s in range(12)] == sig[k].tolist()


def brute(docs, threshold):
    sets = {}
    for i, t in docs:
        if i is not None and t is not None:
            sets[i] = sets.get(i, set()) | shingles(t)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) / len(x | y) >= threshold:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    groups = {i: find(i) for i in sets}
    many = {g for i, g in groups.items() if g != i}
    return {(i, g) for i, g in groups.items() if g in many}


def near_copies():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    docs = []
    for k in range(40):
        base = rng.choices(words, k=rng.randint(30, 200))
        docs.append((10 * k, " ".join(base)))
        for c in range(rng.randint(0, 5)):
            t = list(base)
            for _ in range(len(t) // 40):
                t[rng.randrange(len(t))] = "changed"
            docs.append((10 * k + 1 + c, " ".join(t)))
    return docs


def test_same_groups_as_brute_force(spark, table):
    docs = near_copies()
    got = {(r.doc_id, r.group_id) for r in nd.near_duplicates(table(docs)).collect()}
    want = brute(docs, nd.THRESHOLD)
    assert got <= want and len(got) >= 0.95 * len(want)


def test_copies_passages_and_chains_over_partitions(spark, table, monkeypatch):
    monkeypatch.setattr(nd, "SIDE", 8)  # buckets are cut into blocks
    rng = random.Random(9)
    words = [f"v{i}" for i in range(3000)]
    passage = rng.choices(words, k=60)
    docs = near_copies()
    docs += [(2000 + i, " ".join(rng.choices(words, k=30) + passage + rng.choices(words, k=20))) for i in range(60)]  # a passage, but no near copies
    chain = rng.choices(words, k=100)
    for k in range(6):  # each like the next, the ends unlike
        docs.append((3000 + k, " ".join(chain)))
        chain = chain[18:] + rng.choices(words, k=18)
    docs += [(5000 - i, docs[0][1]) for i in range(40)] + [(6000 + i, docs[3][1].upper() + " !") for i in range(5)]
    want = brute(docs, nd.THRESHOLD)
    for parts in (1, 7):
        got = {(r.doc_id, r.group_id) for r in nd.near_duplicates(table(docs).repartition(parts)).collect()}
        assert got <= want and len(got) >= 0.97 * len(want)
        assert {i for i, _ in got} >= {i for i, _ in docs if i >= 4900}
    far = {r.doc_id for r in nd.near_duplicates(table(docs), bands=100, rows=2).collect()}  # buckets full of others
    assert far == {i for i, _ in want}


def test_an_id_with_several_texts(spark, table):
    rng = random.Random(4)
    a, b, c = (" ".join(rng.choices([f"u{i}" for i in range(900)], k=80)) for _ in range(3))
    rows = [(5, a), (5, b), (7, b), (9, c), (3, a), (11, c + " more"), (2, c)]
    got = {(r.doc_id, r.group_id, r.kept) for r in nd.near_duplicates(table(rows).repartition(3)).collect()}
    assert got == {(3, 3, True), (5, 3, False), (7, 3, False), (2, 2, True), (9, 2, False), (11, 2, False)}


def test_comparison_in_blocks():
    assert nd.least_agreement(0.5, 200) == 50 and nd.least_agreement(0.1, 10) == 0


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(ValueError, match="whole numbers"):
        nd.near_duplicates(spark.createDataFrame([("b2", "x y z")], "doc_id string, text string"))


def test_hub_with_many_members(spark, table):
    docs = near_copies()[:1] * 1
    docs = [(i, docs[0][1]) for i in range(300)] + [(1000, "quite another text of some words")]
    got = {(r.doc_id, r.group_id, r.kept) for r in nd.near_duplicates(table(docs)).collect()}
    assert got == {(i, 0, i == 0) for i in range(300)}


def test_table(spark, table, odd_rows):
    df = table(odd_rows)
    got = {(r.doc_id, r.group_id) for r in nd.near_duplicates(df).collect()}
    assert got == brute([r[:2] for r in odd_rows], nd.THRESHOLD) == {(4, 4), (5, 4), (6, 6), (9, 6)}
    left = nd.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r[0] for r in left.collect()), key=repr) == sorted([None, 1, 2, 3, 4, 4, 6, 7, 8], key=repr)
    assert nd.near_duplicates(df.limit(0)).collect() == [] and nd.drop_near_duplicates(df.limit(0)).count() == 0
