import numpy as np
import pytest

from sparkloom.llm import block_ann as ba


def brute(ids, x, k):
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    out = set()
    for i in range(len(ids)):
        best = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(ids[i], n + 1, ids[j]) for n, j in enumerate(best)}
    return out


def test_error_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = ba.quantise(x)
    dot, err = ba.tile(*q, *q)
    assert (np.abs(dot - x @ x.T) <= err).all() and err.max() < 0.05


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 16)).astype(np.float32)
    x[100:110] = x[0]  # ties
    ids = rng.permutation(5000)[:500].tolist()
    rows = [(int(i), v.tolist(), "a", 1) for i, v in zip(ids, x)]
    odd = [(None, x[0].tolist(), "a", 1), (6001, None, None, None), (6002, [0.0] * 16, "a", 1), (6003, [1.0] * 3, "a", 1), (6004, [float("nan")] * 16, "a", 1), (6005, [None] * 16, "a", 1), (6006, [], "a", 1), rows[0]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, id string, block int")
    got = {(r.vec_id, r["rank"], r.neighbour_id) for r in ba.neighbours(df, k=5, rows=64, shares=3).collect()}
    assert got == brute(ids, x, 5)


def test_queries_among_all_rows_in_chunks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 12)).astype(np.float32)
    x *= 10.0 ** rng.integers(-30, 30, (700, 1))  # a vector's length doesn't matter
    ids = list(range(-100, 600))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id int, embedding array<float>")
    got = {(r.vec_id, r["rank"], r.neighbour_id) for r in ba.neighbours(df, k=4, every=10, rows=32, chunk_bytes=12 * 4 * 20, shares=3).collect()}
    assert got == {t for t in brute(ids, x, 4) if t[0] % 10 == 0} and len(got) == 70 * 4


def test_ids_must_be_whole_numbers(spark):
    df = spark.createDataFrame([("b2", [1.0, 0.0])], "vec_id string, embedding array<float>")
    with pytest.raises(ValueError, match="whole numbers"):
        ba.neighbours(df)


def test_few_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.neighbour_id) for r in ba.neighbours(df).collect()} == {(1, 2), (2, 1)}
    assert ba.neighbours(df.limit(0)).collect() == []
