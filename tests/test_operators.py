"""Operators of the index on small hand-made tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.functions.text import glob_regex, query_tokens, safe_path, tokens, with_fuzzy
from sparkloom.operators import diagnostics, duplicates, fanout, graph, grep, layers, maintain, search, symbols
from sparkloom.operators.edges import QueryError, flatten, query_nodes, query_progress, resolve, with_parents

EDGE = "edge_id long, caller_id long, callee_id long, file_path string, from_ranges string, source string"
SYMBOL = "symbol_id long, name string, kind string, file_path string, start_line int, start_column int, end_line int, end_column int, detail string"
CHUNK = "chunk_id long, file_path string, start_line int, end_line int, symbol_path string, kind string, text string"


def edges(spark, *pairs):
    return spark.createDataFrame([(k, a, b, "f", "[]", "lsp" if k % 2 else "treesitter") for k, (a, b) in enumerate(pairs, 1)], EDGE)


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id long")


def listed(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


CHAIN = ((1, 2), (2, 3))


@pytest.mark.parametrize(
    ("root", "way", "depth", "pairs", "want"),
    [
        (1, "outbound", 2, CHAIN, [(1, 2, 1), (2, 3, 2)]),
        (1, "outbound", 1, CHAIN, [(1, 2, 1)]),
        (3, "inbound", 2, CHAIN, [(1, 2, 2), (2, 3, 1)]),
        (2, "both", 1, CHAIN, [(1, 2, 1), (2, 3, 1)]),
        (1, "both", 1, ((1, 1),), [(1, 1, 1), (1, 1, 1)]),
        (1, "outbound", 5, (*CHAIN, (3, 1)), [(1, 2, 1), (2, 3, 2), (3, 1, 3)]),
        (1, "outbound", 0, CHAIN, [(1, 2, 1)]),
        (1, "outbound", 100, tuple((k, k + 1) for k in range(1, 7)), [(k, k + 1, k) for k in range(1, 6)]),
    ],
)
def test_call_graph(spark, root, way, depth, pairs, want):
    got = graph.call_graph(nodes(spark, root), edges(spark, *pairs), way, depth)
    assert listed(got, "caller_id", "callee_id", "depth") == want


def test_levels_like_breadth_first(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)]
    seen, frontier = {0: 0}, [0]
    for d in (1, 2, 3):
        frontier = sorted({b for a, b in pairs if a in frontier and b not in seen})
        seen |= {x: d for x in frontier}
    assert dict(listed(graph.levels(nodes(spark, 0), edges(spark, *pairs), "outbound", 3), "node_id", "depth")) == seen


def test_unknown_source_fails(spark):
    bad = spark.createDataFrame([(1, 1, 2, "f", "[]", "other")], EDGE)
    with pytest.raises(Exception, match="unknown edge source"):
        graph.call_graph(nodes(spark, 1), bad).collect()


def test_blast_radius(spark):
    s = spark.createDataFrame([(k, f"s{k}", "function", f"{'abc'[k - 1]}.py", 0, 0, 10, 0, None) for k in (1, 2, 3)], SYMBOL)
    found = graph.blast_radius(s, edges(spark, *CHAIN), "c.py", max_hops=2)
    assert listed(found, "hop", "symbol_id") == [(1, 2), (2, 1)]
    assert listed(graph.blast_totals(found), "hop", "symbols", "files") == [(0, 2, 2), (1, 1, 1), (2, 1, 1)]
    assert graph.blast_radius(s, edges(spark, *CHAIN), "a.py").collect() == []
    with pytest.raises(graph.NotFound):
        graph.blast_radius(s, edges(spark, *CHAIN), "a.py", "nobody")


def fuzzy(text, query):
    at, score, text = -1, 0, text.lower()
    for c in query.lower():
        k = text.find(c, at + 1)
        if k < 0:
            return None
        score += 10 + 15 * (at >= 0 and k == at + 1) + 10 * (k == 0 or not text[k - 1].isalnum())
        at = k
    return score


def test_fuzzy_score(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abAB._1", k=rng.randint(0, 9))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for q in ("a", "ab", "aab", "b.1", "AuthService.validate.more", ""):
        assert {r.w: r.s for r in with_fuzzy(df, F.col("w"), q, "s").collect()} == {w: fuzzy(w, q) for w in words}


def test_symbol_tiers(spark):
    paths = ["main", "MyStruct.new", "MyStruct.authenticate", "AuthService.new", "AuthService.validate"]
    df = spark.createDataFrame([(p, p.split(".")[-1], "f", k, "function") for k, p in enumerate(paths)], "qualified_path string, name string, file_path string, start_line int, meta string")
    got = lambda q: listed(symbols.get_symbol(df, q), "qualified_path", "tier")
    assert listed(symbols.get_symbol(df, "MyStruct.new"), "score", "tier") == [(1000, "exact")]
    assert got("new") == [("AuthService.new", "suffix"), ("MyStruct.new", "suffix")]
    assert got("MYSTRUCT.NEW") == [("MyStruct.new", "caseInsensitive")]
    assert got("vldt") == [("AuthService.validate", "fuzzy")]


def test_merge_takes_from_both(spark):
    c = spark.createDataFrame([(1, "f", 3, 9, "A.b", "method", "t"), (2, "f", 20, 22, "C", "type", "u"), (3, "f", 3, 8, "A.later", "method", "v")], CHUNK)
    s = spark.createDataFrame([(5, "b", "method", "f", 3, 4, 5, 0, "d"), (6, "z", "class", "g", 1, 0, 2, 0, None)], SYMBOL)
    assert listed(symbols.merge(c, s), "file_path", "start_line", "name", "qualified_path", "end_line", "source") == [("f", 3, "b", "A.later", 8, "merged"), ("f", 20, "C", "C", 22, "treesitter"), ("g", 1, "z", "z", 2, "lsp")]


VECTOR = "chunk_id long, file_path string, symbol_path string, kind string, text string, embedding array<double>"


@pytest.mark.parametrize(
    ("rows", "threshold", "n"),
    [
        ([("a", "x", "function", [0.9, 0.1]), ("b", "y", "method", [0.89, 0.11])], 0.75, 2),
        ([("a", "x", "function", [1.0, 0.0]), ("b", "y", "type", [1.0, 0.0])], 0.85, 0),
        ([("a", "x", "function", [1.0, 0.0]), ("b", "y", "function", [0.7, 0.7])], 0.85, 0),
        ([("a", "x", "function", [1.0, 0.0]), ("b", "y", "function", [0.7, 0.7])], 0.5, 2),
        ([("a", "x", "function", [1.0, 0.0]), ("a", "x", "function", [1.0, 0.0])], 0.85, 0),
    ],
)
def test_duplicates(spark, rows, threshold, n):
    df = spark.createDataFrame([(k, f, s, kind, "t" * 100, v) for k, (f, s, kind, v) in enumerate(rows)], VECTOR)
    assert duplicates.find_duplicates(df, min_similarity=threshold).count() == n
    assert duplicates.find_duplicates(df, min_similarity=threshold, min_bytes=101).count() == 0


def test_hybrid_search(spark):
    c = spark.createDataFrame([(1, "a", 0, 1, "Network.retryBackoff", "function", "func retryBackoff strategy"), (2, "b", 0, 1, "Other", "function", "retry strategy backoff"), (3, "c", 0, 1, "Num", "function", "123")], CHUNK)
    e = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 1.0])], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([([0.0, 1.0],)], "q array<double>")
    by = {r.chunk_id: r for r in search.hybrid(c, e, "retry backoff", q).collect()}
    assert by[3].bm25 == by[3].trigram == 0 and by[3].cosine == 1 and by[2].cosine == 0
    assert by[1].score > by[2].score > 0 and by[1].bm25 > by[2].bm25
    perfect = search.hybrid(c, e, "retry backoff", q, weights=search.Weights(trigram=0, cosine=0)).collect()
    assert max(r.score for r in perfect) == pytest.approx(1.0)
    assert search.hybrid(c, e, "", q, weights=search.Weights(cosine=0)).collect() == []
    assert tuple(search.progress(c, e).first()) == (3, 2, True)


def test_tokens(spark):
    assert spark.range(1).select(tokens(F.lit("getUserName, x1 FOO")).alias("t")).first().t == ["get", "user", "name", "x1", "foo", "getusername"]
    assert query_tokens("getUserName FOO") == ["get", "user", "name", "getusername", "foo"]


def test_grep(spark):
    c = spark.createDataFrame([(1, "a/x.py", 0, 1, "A", "function", "é foo foo"), (2, "b/y.rs", 0, 1, "B", "function", "foo")], CHUNK)
    assert listed(grep.grep(c, "fo+", ["PY"]), "chunk_id", "n_matches") == [(1, 2)]
    assert listed(grep.grep(c, "fo+", None, "b*"), "chunk_id") == [(2,)]
    assert grep.positions(c.filter("chunk_id = 1"), "fo+").count() == 2
    with pytest.raises(grep.PatternError):
        grep.grep(c, "(")
    assert glob_regex("a*/?.py") == r"^a(?s:.*)/(?s:.)\.py$"


def test_layers(spark):
    p = spark.createDataFrame([(1, "f", 7), (2, "f", 40), (3, "f", 90)], "query_id long, file_path string, line int")
    s = spark.createDataFrame([(1, "outer", "class", "f", 5, 0, 30, 0, None), (2, "inner", "method", "f", 6, 0, 8, 0, "fn inner")], SYMBOL)
    c = spark.createDataFrame([(1, "f", 38, 44, "C", "type", "text")], CHUNK)
    live = spark.createDataFrame([], "query_id long, file_path string, start_line int, end_line int, symbol string, contents string")
    assert listed(layers.definition(p, live, s, c), "query_id", "layer") == [(1, "lspIndex"), (2, "treeSitter"), (3, "none")]
    assert {r.query_id: r.contents for r in layers.hover(p, live, s, c).collect()} == {1: "fn inner", 2: "text", 3: None}
    ranges = spark.createDataFrame([("[[1,2,3,4],[1]]",), ("nonsense",), (None,)], "r string")
    assert [r.s for r in ranges.select(layers.call_sites(F.col("r")).alias("s")).collect()] == [[[1, 2, 3, 4]], [], []]


def test_maintenance(spark):
    s = spark.createDataFrame([(1, "a", "function", "A", 1, 0, 2, 0, None), (2, "b", "function", "A", 5, 0, 6, 0, None), (3, "c", "function", "B", 1, 0, 2, 0, None)], SYMBOL)
    e = spark.createDataFrame([(1, 3, 2, "B", "[]", "lsp"), (2, 1, 1, "A", "[]", "lsp"), (3, 3, 3, "B", "[]", "lsp")], EDGE)
    gone = maintain.vanished(s, s.filter("symbol_id <> 2"))
    assert listed(gone, "symbol_id") == [(2,)] and listed(maintain.invalidated(gone, e), "file_path") == [("B",)]
    c = spark.createDataFrame([(1, "A", 0, 1, "x", "type", "t"), (2, "B", 0, 1, "x", "type", "t")], CHUNK)
    left = maintain.cascade_delete(spark.createDataFrame([("A",)], "file_path string"), c, s, e)
    assert [left[k].count() for k in ("chunks", "symbols", "edges")] == [1, 1, 1]
    index = spark.createDataFrame([("A", "h1", 1), ("B", "h2", 1)], "file_path string, content_hash string, file_size long")
    disk = spark.createDataFrame([("A", "h1", 1), ("B", "new", 1), ("C", "h3", 1)], "file_path string, content_hash string, file_size long")
    assert listed(maintain.reconcile(disk, index), "file_path", "status") == [("A", "unchanged"), ("B", "changed"), ("C", "added")]
    assert maintain.manager_ready(spark.createDataFrame([], "ready boolean")).first().ready


def test_report_is_capped_and_ranked(spark):
    d = [("t", 1)] + [("w", 2)] + [("n", 1)] * 2 + [("clean", 4)]
    diag = spark.createDataFrame([(k, u, s, "m", 0) for k, (u, s) in enumerate(d)], "diag_id long, uri string, severity int, message string, start_line int")
    t = spark.createDataFrame([("t", 0)], "file_path string, ord int")
    dep = spark.createDataFrame([("w",), ("n",), ("clean",)], "file_path string")
    assert [r.uri for r in diagnostics.report(diag, t, dep).orderBy("position").collect()] == ["t", "n", "n", "w"]
    assert tuple(diagnostics.totals(diagnostics.report(diag, t, dep, cap=2)).first()) == (2, 0, 2)


def test_interleave(spark):
    rows = [("A", k) for k in range(1, 6)] + [("B", 1), ("B", 2), ("C", 1)]
    hits = spark.createDataFrame(rows, "root string, rank int")
    order = lambda n: [r.root for r in diagnostics.interleave(hits, n).orderBy("position").collect()]
    assert order(50) == list("ABCABAAA") and order(4) == list("ABCA")


def test_safe_path(spark):
    df = spark.createDataFrame([("a/b",), ("/a",), ("~/a",), ("a/../b",), ("a..b",)], "p string")
    assert [r.s for r in df.select(safe_path(F.col("p")).alias("s")).collect()] == [True, False, False, False, True]


def test_flatten_reaches_every_level(spark):
    chain = [(f, k, f"k{k}", k) for f, n in ((1, 100), (2, 3)) for k in range(n)]
    got = {(r.file, r.node_id): r.path for r in flatten(with_parents(spark.createDataFrame(chain, "file int, node_id int, kind string, depth int"))).collect()}
    assert got == {(f, k): ".".join(f"k{i}" for i in range(k + 1)) for f, k, *_ in chain}
    assert flatten(with_parents(spark.createDataFrame([], "file int, node_id int, kind string, depth int"))).collect() == []


def test_call_edges_with_names_that_differ_in_case(spark):
    paths = [("a", "New"), ("a", "NEW"), ("a", "nEw"), ("b", "New"), ("b", "new"), ("c", "new"), ("d", "X.new"), ("e", "New"), ("e", "NEW"), ("e", "Y.new"), ("f", "call")]
    chunks = spark.createDataFrame([(k, f, 10 * k, 10 * k + 5, p) for k, (f, p) in enumerate(paths)], "chunk_id int, file_path string, start_line int, end_line int, symbol_path string")
    sites = spark.createDataFrame([(1, "f", 101, "new"), (2, "b", 41, "new"), (3, "e", 71, "new"), (4, "f", 101, "neW"), (5, "f", 101, "none")], "site_id int, file_path string, line int, name string")
    got = {r.site_id: (r.callee_file, r.callee_path) for r in resolve(sites, chunks).collect()}
    assert got == {1: ("b", "new"), 2: ("c", "new"), 3: ("e", "Y.new"), 4: ("d", "X.new")}


def test_distinct_trigrams():
    rng = random.Random(2)
    texts = ["", "a", "ab", "abc", "aaaa", "é漢😀é漢😀", "x" * 5000] + ["".join(rng.choices("abcdé漢 ", k=rng.randint(0, 60))) for _ in range(300)]
    want = [len({t[i : i + 3] for i in range(len(t) - 2)}) for t in texts]
    assert text.distinct_trigrams(texts).tolist() == text.distinct_trigrams(texts, width=10).tolist() == want
    many = ["".join(map(chr, range(0x4E00, 0x9000))) + "".join(map(chr, range(0x20000, 0x2F000)))] * 2
    assert text.distinct_trigrams(many).tolist() == [len(many[0]) - 2] * 2


def test_trigram_scores(spark):
    df = spark.createDataFrame([(1, "a.license", "the license version"), (2, "b", None), (3, None, "LICENSE"), (4, "x", "nothing")], "chunk_id long, symbol_path string, text string")
    got = {r.chunk_id: r.trigram for r in search.trigram(df, "license").collect()}
    grams = lambda t: {t.lower()[i : i + 3] for i in range(len(t) - 2)}
    dice = lambda t: 2 * len(grams(t) & grams("license")) / (len(grams(t)) + 5)
    assert got == {1: pytest.approx(5 * dice("a.license") + dice("the license version")), 3: pytest.approx(dice("LICENSE"))}
    assert search.trigram(df, "ab").collect() == []


def test_references_fall_through_the_layers(spark):
    chunks = spark.createDataFrame([(1, "a.py", 0, 2, "A.run", "def run\n  helper()", "function"), (2, "b.py", 5, 5, "B.helper", "helper = 1", "other"), (3, "c.py", 1, 1, "C.x", "x", "other")], "chunk_id long, file_path string, start_line int, end_line int, symbol_path string, text string, kind string")
    symbols_ = spark.createDataFrame([(7, "run", "function", "a.py", 0, 2), (8, "main", "function", "b.py", 0, 9)], "symbol_id long, name string, kind string, file_path string, start_line int, end_line int")
    calls = spark.createDataFrame([(8, 7, "b.py", "[[3,0,3,4]]")], "caller_id long, callee_id long, file_path string, from_ranges string")
    none = spark.createDataFrame([], "file_path string, start_line int, end_line int")
    live = spark.createDataFrame([("z.py", 3, 3), ("z.py", 1, 1)], "file_path string, start_line int, end_line int")
    ask = lambda line, live=none, calls=calls, **how: [tuple(r) for r in layers.references("a.py", line, live, symbols_, calls, chunks, **how).orderBy("file_path", "start_line").collect()]
    assert ask(0, live, limit=1) == [("z.py", 1, None, "liveLSP", 2)]
    assert ask(0) == [("b.py", 3, "main", "lspIndex", 1)]
    assert ask(1, calls=calls.limit(0)) == [("a.py", 0, "run", "treeSitter", 2), ("b.py", 5, "main", "treeSitter", 2)]
    assert ask(9) == []


def test_fan_out_keeps_going(spark):
    ok = spark.createDataFrame([(1, "x"), (2, "y")], "rank int, v string")
    late = ok.withColumn("v", F.raise_error(F.lit("late")).cast("string"))
    got, failed = fanout.fan_out(spark, {"b": lambda: ok, "a": lambda: ok, "c": lambda: late, "d": lambda: 1 / 0}, 3)
    assert [(r["root"], r["v"]) for r in got.orderBy("position").collect()] == [("a", "x"), ("b", "x"), ("a", "y")]
    assert {r["root"] for r in failed.collect()} == {"c", "d"}
    assert fanout.fan_out(spark, {}, 3)[0] is None


def test_root_of_a_name_or_place(spark):
    symbols_ = spark.createDataFrame([(7, "run", "function", "a.py", 0, 2, 0), (8, "main", "function", "b.py", 4, 9, 0)], "symbol_id long, name string, kind string, file_path string, start_line int, end_line int, start_column int")
    named = symbols_.select("file_path", "start_line", "name", F.col("name").alias("qualified_path"))
    ask = lambda x: [r.node_id for r in graph.root_of(x, named, symbols_).collect()]
    assert ask("b.py:5:0") == [8] and ask("run") == [7] and ask("mn") == [8]
    with pytest.raises(graph.NotFound):
        ask("nothing_like_it")


def test_duplicates_in_blocks_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", 16)
    rng = random.Random(4)
    rows = [(i, f"f{i % 7}", f"s{i % 50}", ("function", "method", "type", "x")[i % 4], [rng.gauss(0, 1) for _ in range(4)], "t" * (150 if i % 9 else 20)) for i in range(150)]
    df = spark.createDataFrame(rows, "chunk_id long, file_path string, symbol_path string, kind string, embedding array<double>, text string")
    part = lambda k: {"function": "c", "method": "c"}.get(k, k)
    for file in (None, "f3"):
        want = set()
        for a in rows:
            if len(a[5]) >= 100 and file in (None, a[1]):
                near = [(round(-sum(x * y for x, y in zip(a[4], b[4])), 9), b[0]) for b in rows if len(b[5]) >= 100 and part(a[3]) == part(b[3]) and a[1:3] != b[1:3]]
                want |= {(a[0], b, k + 1) for k, (s, b) in enumerate(sorted(x for x in near if -x[0] >= 1.5)[:5])}
        got = {(r.source_id, r.match_id, r["rank"]) for r in duplicates.find_duplicates(df, file=file, min_similarity=1.5).collect()}
        assert got == want and got, file
    assert duplicates.compared(df).first()["compared"] == sum(len(r[5]) >= 100 for r in rows)


def test_node_queries(spark):
    rows = [("f", 0, "ul", 1, "<ul>"), ("f", 1, "li", 2, "one"), ("f", 2, "a", 3, "x"), ("f", 3, "li", 2, "two"), ("f", 4, "a", 3, "y"), ("g", 0, "ul", 1, ""), ("g", 1, "li", 2, "one")]
    n = with_parents(spark.createDataFrame([r[:4] for r in rows], "file string, node_id int, kind string, depth int"))
    n = n.join(spark.createDataFrame([(r[0], r[1], r[4]) for r in rows], "file string, node_id int, text string"), ["file", "node_id"])
    ask = lambda q: sorted((r.file, r.node_id, r.capture) for r in query_nodes(n, q, None).collect())
    assert ask("(ul (li) @a (li (a) @b))") == [("f", 1, "a"), ("f", 4, "b")]
    assert ask('(ul (li (a) @b) @a (#eq? @a "two"))') == [("f", 3, "a"), ("f", 4, "b")]
    assert ask('(ul (_) @a (#match? @a "^o")) @u') == [("f", 0, "u"), ("f", 1, "a"), ("g", 0, "u"), ("g", 1, "a")]
    assert ask("(li)") == [("f", 1, ""), ("f", 3, ""), ("g", 1, "")]
    for bad in ("", "(", "(a", "a", "(a))", "(a) (b)", '(a (#eq? @x "y"))', "@a (a)"):
        with pytest.raises(QueryError):
            query_nodes(n, bad)
    files = spark.createDataFrame([("a",), ("f",), ("g",), ("h",)], "file string")
    assert [tuple(query_progress(n, files, "(li)", k).first()) for k in (1, 2, 3, 4)] == [(2, True), (2, True), (3, True), (4, False)]


def ran(df, metric, *names):
    """The metric of each node of the plan that `df.collect()` has run whose name begins with one of `names`."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.nodeName()
        if kind == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
        else:
            todo += [node.children().apply(k) for k in range(node.children().size())]
            if kind.startswith(names) and node.metrics().contains(metric):
                out.append(node.metrics().apply(metric).value())
    return out


def test_duplicates_leave_only_the_best_of_a_block(spark):
    n = 400
    rows = [(k, f"f{k}", f"s{k}", "function", [1.0, k % 4 * 0.01]) for k in range(n)]
    df = spark.createDataFrame(rows, "chunk_id long, file_path string, symbol_path string, kind string, embedding array<double>")
    found = duplicates.find_duplicates(df, min_similarity=0.5, text_col=None)
    assert ran(found, "pythonNumRowsReceived", "MapInArrow")[0] == n * 5
    got = {(r.source_id, r.rank): r.match_id for r in found.collect()}
    for source in range(n):
        v = rows[source][4]
        best = sorted((k for k in range(n) if k != source), key=lambda k: (-round(v[0] * rows[k][4][0] + v[1] * rows[k][4][1], 9), k))
        assert [got[source, k] for k in range(1, 6)] == best[:5]


def test_duplicates_round_as_spark_does(spark):
    like = [0.1234567885, 0.1234567895, 0.5, 1.0000000005, 0.2999999995, -0.1234567885, 12345678.1234567895, 0.30000000049999999, 3e15]
    want = [r.x for r in spark.createDataFrame([(x,) for x in like], "x double").select(F.round("x", 9).alias("x")).collect()]
    assert list(duplicates._billionths(np.array(like)) / 1e9) == want


def test_matches_across_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", 16)
    monkeypatch.setattr(duplicates, "TASK_BYTES", 1 << 10)
    v = np.random.default_rng(1).integers(-3, 4, (120, 4)).astype(float)
    kinds = ["function", "type", "other"]
    df = spark.createDataFrame([(k, f"f{k // 2}", f"s{k % 3}", kinds[k % 3], v[k].tolist()) for k in range(120)], "chunk_id long, file_path string, symbol_path string, kind string, embedding array<double>")
    got = {(r.source_id, r.rank): r.match_id for r in duplicates.find_duplicates(df, min_similarity=2, text_col=None).collect()}
    want = {}
    for a in range(120):
        fits = [b for b in range(120) if b % 3 == a % 3 and b // 2 != a // 2 and v[a] @ v[b] >= 2]
        want |= {(a, k + 1): b for k, b in enumerate(sorted(fits, key=lambda b: (-(v[a] @ v[b]), b))[:5])}
    assert got == want


_SPANS = "symbol_id long, file_path string, start_line int, end_line int, name string"


def test_equal_places_meet_the_spans_once(spark):
    spans = spark.createDataFrame([(k, "a", 40 - k, 60 + k, f"s{k}") for k in range(30)], _SPANS)
    positions = spark.createDataFrame([(k, "a", 50) for k in range(500)] + [(7, "a", 11)], "query_id long, file_path string, line int")
    found = layers.enclosing(positions, spans, "symbol_id")
    assert max(ran(found, "numOutputRows", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin")) <= 501
    assert sorted((r.query_id, r.symbol_id) for r in found.collect()) == [(k, 0) for k in range(500)]


def test_a_cascade_works_out_its_answers_once(spark):
    calls = spark.sparkContext.accumulator(0)
    mark = F.udf(lambda x: calls.add(1) or x).asNondeterministic()
    answers = spark.createDataFrame([(k, "x") for k in range(20)], "query_id long, contents string")
    second = answers.withColumn("query_id", mark("query_id").cast("long"))
    got = layers.cascade(answers, answers.filter("query_id < 5"), second).collect()
    assert calls.value == 20
    assert sorted((r.query_id, r.layer) for r in got) == [(k, "liveLSP" if k < 5 else "lspIndex") for k in range(20)]


def test_callers_are_not_shuffled_for_each_position(spark):
    symbols = spark.createDataFrame([(k, "a", 10 * k, 10 * k + 5, f"s{k}") for k in range(40)], _SPANS)
    edges = spark.createDataFrame([(k, 0, "[[1,2,3,4],[1,2,3,4]]") for k in range(1, 40)], "caller_id long, callee_id long, from_ranges string")
    positions = spark.createDataFrame([(k, "a", 0 if k < 300 else 7) for k in range(400)], "query_id long, file_path string, line int")
    live = spark.createDataFrame([(k, f"l{j}", "b", 1) for k in (0, 399) for j in range(2)], "query_id long, name string, file_path string, n_sites long")
    found = layers.incoming(positions, live, symbols, edges)
    assert sum(ran(found, "shuffleRecordsWritten", "Exchange")) < 39 * 300
    got = sorted(tuple(r) for r in found.select("query_id", F.coalesce("name", F.lit("")), F.coalesce("n_sites", F.lit(0)), "layer").collect())
    want = [(k, f"l{j}", 1, "liveLSP") for k in (0, 399) for j in range(2)] + [(k, f"s{j}", 2, "lspIndex") for k in range(1, 300) for j in range(1, 40)] + [(k, "", 0, "none") for k in range(300, 399)]
    assert got == sorted(want)


def test_postings_shuffle_chunks_not_words(spark):
    words = " ".join(f"w{k} aB{k}" for k in range(50))
    df = spark.createDataFrame([(k, words, f"Doc{k}.w1") for k in range(20)] + [(3, "w1 w1", "x"), (4, words, "Doc4.w1")], "chunk_id long, text string, symbol_path string")
    found = search.postings(df)
    assert sum(ran(found, "shuffleRecordsWritten", "Exchange")) <= 22
    got = {(r.chunk_id, r.term, r.length): r.tf for r in found.collect()}
    assert len(got) == found.count()
    assert (got[0, "w1", 202], got[4, "w1", 202], got[0, "ab7", 202], got[0, "b7", 202]) == (6, 12, 1, 1)
    assert {k[1:]: v for k, v in got.items() if k[0] == 3 and k[2] == 3} == {("w1", 3): 2, ("x", 3): 5}


def test_searches_go_through_texts_once(spark):
    calls = spark.sparkContext.accumulator(0)
    mark = F.udf(lambda x: calls.add(1) or x).asNondeterministic()
    df = spark.createDataFrame([(k, f"license {k}", "a.b") for k in range(20)], "chunk_id long, text string, symbol_path string")
    assert len(search.bm25(df.withColumn("text", mark("text")), "license version").collect()) == 20
    assert calls.value == 20
    found = search.trigram(df, "license version")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 2
    assert found.count() == 20
