"""A directory's index from end to end: built, updated, asked."""

import pytest

from sparkloom.operators import graph, search
from sparkloom.operators.symbols import get_symbol, merge
from sparkloom.plans.index import TABLES, Index, embed
from sparkloom.sources import chunker, tree

FILES = {
    "src/a.py": "def run():\n    helper()\n    Tool().make()\n\n\nclass Tool:\n    def make(self):\n        return shape()\n",
    "src/b.py": "def helper():\n    return 1\n\n\ndef unused():\n    helper()\n",
    "lib/c.rs": "impl Shape {\n    fn area(&self) { shape(); }\n}\nfn shape() {}\n",
    "build/gone.py": "def hidden():\n    run()\n",
    "doc/d.md": "# Retry back-off\ntext\n## Part\n",
    "conf.json": '{"a": {"b": 1}}',
}
RULES = {"": "build/\n"}


def write(folder, files):
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)


def rows(index):
    return {t: sorted(map(repr, index.table(t).select(*sorted(index.table(t).columns)).collect())) for t in TABLES}


def calls(index):
    named = graph.with_names(index.edges().select("edge_id", "caller_id", "callee_id"), index.symbols())
    return sorted((r.caller_name, r.callee_name) for r in named.collect())


def test_build_update_and_ask(spark, tmp_path):
    root, rules = tmp_path / "root", tree.ignore_rules(spark, RULES)
    write(root, FILES)
    index = Index(spark, str(tmp_path / "index"))
    with pytest.raises(LookupError):
        index.table("files")
    index.build(str(root), rules)
    assert sorted(r.file_path for r in index.table("files").collect()) == ["conf.json", "doc/d.md", "lib/c.rs", "src/a.py", "src/b.py"]
    assert calls(index) == [("area", "shape"), ("make", "shape"), ("run", "Tool"), ("run", "helper"), ("run", "make"), ("unused", "helper")]
    paths = {r.symbol_path for r in index.chunks().collect()}
    assert {"run", "Tool", "Tool.make", "helper", "impl Shape", "impl Shape.area", "shape", "Retry back-off", "Retry back-off.Part", "pair"} <= paths
    found = search.bm25(index.chunks(), "backoff retry back").orderBy("bm25", ascending=False).first()
    assert found.chunk_id in {r.chunk_id for r in index.chunks().filter("file_path = 'doc/d.md'").collect()}
    merged = merge(index.chunks(), index.symbols())
    assert [r["name"] for r in get_symbol(merged, "Tool.make").collect()] == ["make"]
    assert graph.call_graph(graph.root_of("run", merged, index.symbols()), index.edges(), "outbound", 2).count() == 4

    # nothing new, then a change, a removal and an addition: as if built anew
    assert tuple(index.update(str(root), rules).first()) == (5, 0, 0, 0) and index.versions() == [1]
    write(root, {"src/b.py": "\n\ndef unused():\n    helper()\n", "src/z.py": "def helper():\n    unused()\n", "lib/e.rs": "fn shape() {}\n"})
    (root / "lib/c.rs").unlink()
    assert tuple(index.update(str(root), rules).first()) == (6, 2, 1, 1)
    anew = Index(spark, str(tmp_path / "anew"))
    anew.build(str(root), rules)
    assert rows(index) == rows(anew)
    assert calls(index) == [("helper", "unused"), ("make", "shape"), ("run", "Tool"), ("run", "helper"), ("run", "make"), ("unused", "helper")]
    (root / "lib/e.rs").unlink()
    index.update(str(root), rules)
    assert index.versions() == [2, 3] and ("make", "shape") not in calls(index)


def test_embedder_failures_stay_with_their_texts(spark):
    def embedder(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t)), 1.0] if "short" not in t else [0.0] for t in texts]

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None), (4, "short"), (5, "fine")], "id int, t string").coalesce(1)
    from pyspark.sql import functions as F

    got = {r.id: r.v for r in df.select("id", embed(F.col("t"), embedder, 2, 4).alias("v")).collect()}
    assert got == {1: [2.0, 1.0], 2: None, 3: None, 4: None, 5: [4.0, 1.0]}
    few = df.select("id", embed(F.col("t"), lambda texts: [[1.0, 2.0]], 2, 4).alias("v")).collect()
    assert {r.id for r in few if r.v is None} == {3}


def test_modules_and_data_formats():
    shout = chunker.Module("shout", ("sh0",), lambda path, text: ([(0, len(text), "ALL", "other")], [(2, "x")]))
    assert chunker.parse("a.sh0", "ab\ncd", [shout]) == ([("a.sh0", 0, 5, 0, 1, "ab\ncd", "ALL", "other")], [("a.sh0", 0, "x")])
    assert chunker.parse("a.sh0", "ab") == ([], []) and chunker.parse("a.sql", "select 1") == ([], [])
    pairs = chunker.parse("a.json", '{"a": 1, "b": {"c": [1, {"d": "x,}"}]}, // k\n "é": null}')[0]
    assert [(r[5], r[6], r[7]) for r in pairs] == [(x, "pair", "other") for x in ('"a": 1', '"b": {"c": [1, {"d": "x,}"}]}', '"c": [1, {"d": "x,}"}]', '"d": "x,}"', '"é": null')]
    assert pairs[-1][1:3] == (46, 56)
    text = "a: 1\nb:\n  c: 2\n  d:\n    - e: 1\n      f: 2\n    - g: 3\nh: |\n  x: no\n# c: d\ni: http://x\n"
    assert [r[5].split(":")[0] for r in chunker.parse("a.yml", text)[0]] == list("abcdefghi")
    assert {r[5].split(":")[0]: (r[3], r[4]) for r in chunker.parse("a.yml", text)[0]} == {"a": (0, 0), "b": (1, 6), "c": (2, 2), "d": (3, 6), "e": (4, 4), "f": (5, 5), "g": (6, 6), "h": (7, 8), "i": (10, 10)}


def test_chunker_takes_time_in_proportion():
    import time

    def took(n):
        text = "\n".join(f"fn f{i}(x: i32) {{ g{i}(x); h(x); é(x) }}" for i in range(n))
        began = time.process_time()
        assert len(chunker.parse("a.rs", text)[0]) == n
        return time.process_time() - began

    took(500)
    assert took(16_000) < 40 * max(took(1000), 0.01)
