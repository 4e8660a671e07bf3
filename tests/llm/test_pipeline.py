import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as cp
from sparkloom.llm import near_dedup, secret_scan

from .conftest import row
from .test_near_dedup import brute
from .test_quality_knn import corpus
from .test_secret_scan import KEY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "c0", "id", "h", "key"]


def folder(tmp_path, rows, labels):
    docs = pa.table({c: pa.array([r[k] for r in rows], pa.string() if c in ("text", "lang", "source", "c0", "id", "h") else pa.int64()) for c, k in zip(COLUMNS, (0, 1, 2, 3, 4, 5, 6, 7, 9))})
    pq.write_table(docs, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([a for a, _ in labels], pa.int64()), "quality": pa.array([b for _, b in labels], pa.int32()), "toxic": pa.array([0 for _ in labels], pa.int32())}), tmp_path / "labels.parquet")
    return str(tmp_path)


@pytest.fixture
def data(tmp_path, odd_rows):
    c = corpus(200, 5)
    rows = [row(100 + i, t, ("de", "en", "fr")[i % 3]) for i, (t, _) in enumerate(c)] + odd_rows
    rows += [row(500, c[0][0] + f" token = {KEY} end"), row(501, c[2][0]), row(502, c[2][0])]
    return folder(tmp_path, rows, [(100 + i, y) for i, (_, y) in enumerate(c)])


def test_stages_one_by_one(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        before = docs.collect()
        docs = cp.written(stage(spark, docs, data), f"test-{k}")
        assert docs.columns == columns, name
        after = docs.collect()
        sizes.append(len(after))
        if stage is cp.near_dedup:
            gone = {i for i, g in brute([(r.doc_id, r.text) for r in before], near_dedup.THRESHOLD) if i != g}
            assert {r.doc_id for r in after} == {r.doc_id for r in before} - gone
            assert {501, 502}.isdisjoint({r.doc_id for r in after})
        elif stage is cp.secrets:
            with open(secret_scan.VOCABULARY, "rb") as f:
                encode = secret_scan._encoder(f.read())
            for r in before:
                text = None if r.text is None else secret_scan.mask(r.text, secret_scan.scan(r.text, encode))
                assert any(x.doc_id == r.doc_id and x.text == text and (text is None or x.n_chars is None or x.n_chars == len(text)) for x in after)
        else:
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    assert sizes[1] < sizes[0] and sizes[3] < sizes[2] and sizes[4] == sizes[3]
    packed = {r.doc_id for r in cp.packing(spark, docs, data).collect()}
    assert packed == {r.doc_id for r in docs.collect() if r.text}


def test_run_equals_the_stages(spark, data):
    got = sorted(map(repr, cp.run(spark, data).collect()))
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES):
        docs = cp.written(stage(spark, docs, data), f"again-{k}")
    assert got == sorted(map(repr, docs.collect())) and got


def test_empty_tables(spark, tmp_path):
    assert cp.run(spark, folder(tmp_path, [], [])).collect() == []
