"""Streams, trees, languages and the chunker."""

import datetime as dt
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkloom.functions import codec
from sparkloom.sources import chunker, languages, tree
from sparkloom.streaming import events


def event(seq, ms, path, kind):
    return (seq, dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms), path, kind)


SCHEMA = "seq long, ts timestamp, path string, kind string"
BURSTS = [event(k, 100 * k, "a.py", "modified") for k in range(5)] + [event(5, 450, "b.py", "created"), event(6, 2000, "a.py", "removed"), event(7, 2500, "b.py", "modified")]


def test_debounce_last_kind_wins(spark):
    got = events.debounce(spark.createDataFrame(BURSTS, SCHEMA), 1000).collect()
    assert sorted((r.session, r.path, r.kind) for r in got) == [(1, "a.py", "modified"), (1, "b.py", "created"), (2, "a.py", "removed"), (2, "b.py", "modified")]


def test_debounce_over_buckets_like_a_loop(spark, monkeypatch):
    monkeypatch.setattr(events, "BUCKET_GAPS", 3)
    rows = [event(k, (k * k * 37) % 9000, f"p{k % 4}", "modified") for k in range(60)]
    want, n, last = {}, 0, None
    for seq, ts, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if last is None or (ts - last).total_seconds() * 1000 >= 120:
            n += 1
        want[seq], last = n, ts
    assert {r.seq: r.session for r in events.sessions(spark.createDataFrame(rows, SCHEMA), 120).collect()} == want


def test_debounce_stream_equals_the_table(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    far = event(99, 60_000, "z.py", "modified")
    for k, rows in enumerate((BURSTS[:4], BURSTS[4:6], BURSTS[6:], [far], [event(100, 120_000, "z.py", "modified")])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        s = spark.readStream.schema(SCHEMA).parquet(str(src)).withWatermark("ts", "0 seconds")
        q = events.debounce_stream(s, 1000).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        time.sleep(0.1)
    got = sorted((r.session, r.path, r.kind) for r in spark.read.parquet(str(out)).collect())
    assert got[:4] == [(1, "a.py", "modified"), (1, "b.py", "created"), (2, "a.py", "removed"), (2, "b.py", "modified")]


def test_settle(spark):
    rows = [("quiet", None), ("one", 200), *[("busy", k * 250) for k in range(40)]]
    got = {r.request: (r.outcome, r.at_ms) for r in events.settle(spark.createDataFrame(rows, "request string, at_ms long")).collect()}
    assert got == {"quiet": ("settled", 300), "one": ("settled", 500), "busy": ("pending", 5000)}


@pytest.mark.parametrize("name", ["settle_outcome", "watcher_debounce"])
def test_times_count_in_whole_milliseconds_to_the_nearest(spark, tmp_path, name):
    stamps = ["'2024-01-01 00:00:02.999499'", "'2024-01-01 00:00:02.9995'", "'2024-01-01 00:10:02.999499'", "'2024-01-01 00:20:02.9994'", "'2024-01-01 00:30:02.9988'", "'2023-12-31 23:59:58.2'"]
    con = duckdb.connect()
    rows = ", ".join(f"({k}::BIGINT, {s}::TIMESTAMP, {k}::BIGINT, 'view', 1.0::DOUBLE, '')" for k, s in enumerate(stamps))
    con.execute(f"copy (select * from (values {rows}) t(event_id, ts, user_id, event_type, value, props)) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).select(*columns).collect())) == sorted(want.fetchall())


def test_versions(spark):
    rows = [(k, dt.datetime(2024, 1, 1, 0, 0, k), "a", h) for k, h in enumerate("xxyyx")]
    got = events.versions(spark.createDataFrame(rows, "seq long, ts timestamp, path string, hash string")).orderBy("seq").collect()
    assert [(r.version, r.sent) for r in got] == [(1, True), (1, False), (2, True), (2, False), (3, True)]


def test_ignore_rules(spark):
    rules = tree.ignore_rules(spark, {"": "*.log\n!keep.log\nbuild/\n/top.txt\ndocs/**/x.md\n", "sub": "*.tmp\n"})
    rows = [("a.log", False), ("keep.log", False), ("build", True), ("build/x.py", False), ("top.txt", False), ("sub/top.txt", False), ("docs/a/b/x.md", False), ("sub/a.tmp", False), ("a.tmp", False), ("sub", True), ("docs", True)]
    got = {r.path for r in tree.visible(spark.createDataFrame(rows, "path string, is_dir boolean"), rules).collect()}
    assert got - {"sub", "docs"} == {"keep.log", "sub/top.txt", "a.tmp"}


def test_porcelain(spark):
    lines = ["?? new.py", " M a.py", "R  old.py -> b.py", "D  gone.py", "UU both.py", "AM c.txt"]
    got = tree.scope(tree.porcelain(spark.createDataFrame(list(enumerate(lines)), "position long, line string")), ["py"])
    assert sorted(r.path for r in got.collect()) == ["a.py", "b.py", "new.py"]


def test_projects(spark):
    entries = spark.createDataFrame([("b", "Cargo.toml"), ("a", "package.json"), ("a", "README")], "dir string, name string")
    got = languages.detect_projects(entries).collect()
    assert [r.dir for r in got][:1] == ["a"] and {r.dir for r in got} == {"a", "b"}


PY = "class A:\n    def run(self):\n        return Helper.do_work(1)\n\ndef f():\n    pass\n"
RUST = "impl Foo {\n    fn bar(&self) { baz(); }\n}\n"


def test_chunker(spark):
    files = spark.createDataFrame([("a.py", PY), ("b.rs", RUST), ("bad.py", "def ("), ("none.py", None), ("x.unknown", "def f(): pass")], "file_path string, content string")
    got = {(r.file_path, r.symbol_path, r.start_line) for r in chunker.chunks(files).collect()}
    assert {("a.py", "A", 0), ("a.py", "A.run", 1), ("a.py", "f", 4), ("b.rs", "impl Foo", 0), ("b.rs", "impl Foo.bar", 1)} == got
    assert {("a.py", "do_work"), ("b.rs", "baz")} <= {(r.file_path, r.name) for r in chunker.calls(files).collect()}


def test_codec_round_trip(spark):
    df = spark.createDataFrame([([1.5, -2.0],), ([],), (None,)], "v array<float>")
    back = df.select(codec.from_blob(codec.to_blob("v")).alias("v")).collect()
    assert [r.v for r in back] == [[1.5, -2.0], [], None]


def test_range_and_glob_scopes(spark):
    lines = [(0, "M\tsrc/a.py"), (1, "D\tsrc/b.py"), (2, "R100\told.py\tsrc/c.py"), (3, "A\t../x.py"), (4, "T\tsrc/t.py"), (5, "M\tsrc/a.py")]
    got = tree.scope(tree.changed(spark.createDataFrame(lines, "position long, line string")), ["py"]).collect()
    assert [r.path for r in got] == ["src/a.py", "src/c.py"]
    assert tree.diff_range("main") == "main..HEAD" and tree.diff_range("a..b") == "a..b"
    files = spark.createDataFrame([("src/a.py",), ("src/sub/b.py",), ("src/.h.py",), ("src/b.txt",)], "file_path string")
    ask = lambda p: [r.path for r in tree.matching(files, p).orderBy("position").collect()]
    assert ask("src/*.py") == ["src/a.py"] and ask("src/*/b.??") == ["src/sub/b.py"] and ask("no/such.py") == ["no/such.py"] and ask("zzz*") == []


def test_rules_beyond_the_broadcast(spark, monkeypatch):
    entries = spark.createDataFrame([("a/x.log", False), ("a/y.py", False), ("a", True), ("b/x.log", False), ("b/keep.log", False), ("b", True)], "path string, is_dir boolean")
    rules = tree.ignore_rules(spark, {"": "*.log\n", "b": "!keep.log\n"})
    want = ["a/y.py", "b/keep.log"]
    assert sorted(r.path for r in tree.visible(entries, rules).collect()) == want
    monkeypatch.setattr(tree, "RULES", 1)
    assert sorted(r.path for r in tree.visible(entries, rules).collect()) == want


def test_walk(spark, tmp_path):
    for name, content in (("src/a.py", b"x = 1\n"), ("src/B.PY", b"y"), ("src/c.bin", b"z"), (".git/d.py", b"z"), ("build/e.py", b"z"), ("f.md", b"\xff\xfe"), ("g.rs", "é".encode())):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = {r.file_path: r for r in tree.walk(spark, str(tmp_path), tree.ignore_rules(spark, {"": "build/\n"})).collect()}
    assert set(rows) == {"src/a.py", "src/B.PY", "f.md", "g.rs"}
    assert rows["src/a.py"].content == "x = 1\n" and rows["f.md"].content is None and rows["g.rs"].content == "é" and rows["g.rs"].file_size == 2


def test_accepted_events(spark):
    e = spark.createDataFrame([(1, "/ws/a.py"), (2, "/ws/.git/b.py"), (3, "/other/a.py"), (4, "/ws/build/c.py"), (5, "/ws/d.bin"), (6, "/ws/a.py")], "seq long, path string")
    got = events.accepted(e, ["py"], "/ws", tree.ignore_rules(spark, {"": "build/\n"}))
    assert sorted((r.seq, r.path) for r in got.collect()) == [(1, "a.py"), (6, "a.py")]


def test_backoff(spark):
    got = [r.s for r in spark.range(9).select(events.backoff(F.col("id")).alias("s")).orderBy("s").collect()]
    assert got == [1, 2, 4, 8, 16, 32, 60, 60, 60]


def test_index_loop_drains_every_batch(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, f"f{k}.py"), (k, f"g{k}.py")], "seq long, path string").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema("seq long, path string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    events.index_loop(stream, lambda df: seen.append(sorted(r.path for r in df.collect())), str(tmp_path / "cp")).awaitTermination()
    assert sorted(x for batch in seen for x in batch) == ["f0.py", "f1.py", "f2.py", "g0.py", "g1.py", "g2.py"] and len(seen) >= 3


def test_debounce_stream_takes_any_path(spark, tmp_path):
    odd = ["a\x1fb", "c\x1ed", 'e"f', "ü\\g", ""]
    rows = [event(k, 100 * k, p, "modified") for k, p in enumerate(odd)]
    spark.createDataFrame([*rows, event(99, 90_000, "later", "created")], "seq long, ts timestamp, path string, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, ts timestamp, path string, kind string").parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
    q = events.debounce_stream(stream, 1000).writeStream.format("memory").queryName("odd_paths").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.path for r in spark.table("odd_paths").filter("session = 1").collect()) == sorted(odd)
