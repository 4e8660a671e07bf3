import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkloom.llm import quality_rules as qr

from .conftest import PROSE


def docs():
    out = [(1000 + i, " ".join(PROSE["en"].split()[i % 7 :]) + "\n" + PROSE["en"], "en", "web") for i in range(150)]
    out += [(2000 + i, PROSE["de"] + f" {i}", "de", "book") for i in range(20)]
    return out + [(900, "#$%& {} <> " * 40, "en", "web"), (901, "spam " * 300, "en", "web"), (902, "SHOUTING WORDS " * 60, "en", "web")]


def test_junk_goes_and_prose_stays(table):
    kept = {r.doc_id for r in qr.judge(table(docs())).filter("kept").collect()}
    assert not kept & {900, 901, 902} and len(kept) == 170


def test_same_as_sql(table, odd_rows, tmp_path):
    df = table([*docs(), *odd_rows])
    pd.DataFrame([tuple(r)[:5] for r in df.collect()], columns=df.columns[:5]).to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/d.parquet')")
    want = sorted(con.execute(qr.SQL3).fetchall(), key=repr)
    got = sorted((tuple(r) for r in qr.judge(df).filter("kept").select("doc_id", "lang", "source").collect()), key=repr)
    assert [(None if pd.isna(a) else int(a), b, c) for a, b, c in want] == got or sorted(map(repr, got)) == sorted(repr((None if pd.isna(a) else int(a), b, c)) for a, b, c in want)


def test_defined_cases(table, odd_rows):
    df = table([*docs(), *odd_rows])
    by = {}
    for r in qr.judge(df).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert [r.broken for r in by[1] + by[2]] == ["words", "words"] and len(by[4]) == 2
    assert qr.judge(df.limit(0)).collect() == []


def test_sketches_above_their_size(spark):
    """Ranks of merged sketches of far more values than they hold are off by little, and so are the documents judged."""
    rng = np.random.default_rng(8)
    values = rng.permutation(60_000)
    df = spark.createDataFrame([(float(v), int(v) % 7) for v in values], "v double, source int").repartition(11)
    fine = df.groupBy("source").agg(F.kll_sketch_agg_double("v", F.lit(qr.SKETCH_K)).alias("s"))
    whole = fine.agg(F.kll_merge_agg_double("s", F.lit(qr.SKETCH_K)).alias("s"))
    for p in (0.1, 0.5):
        got = whole.select(F.kll_sketch_get_quantile_double("s", F.lit(p))).first()[0]
        assert abs(got - p * 60_000) <= 0.005 * 60_000
    words = ["alpha", "beta", "gamma", "delta"]
    texts = [" ".join(rng.choice(words, 30)) + " " + "1" * int(rng.integers(0, 30)) for _ in range(4000)]
    docs = spark.createDataFrame([(i, t + (" " + "7" * 400 if i % 50 == 0 else ""), "en", "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in qr.judge(docs).filter("kept").collect()}
    m = docs.select("doc_id", qr.measures(F.col("text"))["digits"].alias("x")).toPandas()
    x = m["x"].to_numpy()
    limit = [np.quantile(x, 0.5 + e) + qr.SPREAD * max(np.quantile(x, 0.5 + e) - np.quantile(x, 0.1 - e), qr.RULES["digits"]) for e in (-0.005, 0.005)]
    sure = (x < min(limit)) | (x > max(limit))
    assert sure.mean() > 0.97 and {int(i) for i, v in zip(m["doc_id"], x) if v > max(limit)}.isdisjoint(kept)
    assert len(kept) >= 0.95 * (x < min(limit)).sum() and all(i % 50 for i in kept)


def test_ties_repeats_and_clashing_names(spark, table):
    df = table([*[(i, f"some plain words number {i % 3} here") for i in range(200)], (5, "some plain words number 2 here"), (300, ("a plain line of words\n") * 30_000), (301, None), (302, "")])
    rows = qr.judge(df).collect()
    assert len(rows) == 204 and [r.kept for r in rows if r.doc_id == 5] == [True, True]
    by = {r.doc_id: r.broken for r in rows}
    assert by[301] == by[302] == "words" and "lines" in by[300]
    assert qr.judge(df.limit(0)).collect() == []
