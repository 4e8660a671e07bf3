"""The registered queries: every operator over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import safe_path
from ..operators import diagnostics as dg
from ..operators import duplicates, edges, fanout, graph, grep, layers, maintain, search, symbols
from ..sources import languages, tree
from ..sources.adapters import Model
from ..streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TEXT = "license version"


def query(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
    QUERIES[f.__name__] = lambda spark, folder: f(Model(spark, folder))
    return f


def _top(df: DataFrame, name: str, k: int = 20) -> DataFrame:
    return df.orderBy(F.desc(F.round(name, 9)), "chunk_id").limit(k).select("chunk_id", F.round(name, 6).alias("score"))


def _query_vector(m: Model) -> DataFrame:
    return m.embedded().filter("chunk_id = 0").select(F.col("embedding").alias("q"))


@query
def search_bm25(m: Model) -> DataFrame:
    return _top(search.bm25(m.chunks(), TEXT), "bm25")


@query
def search_trigram(m: Model) -> DataFrame:
    return _top(search.trigram(m.chunks(), TEXT), "trigram")


@query
def search_cosine(m: Model) -> DataFrame:
    return search.cosine(m.embedded(), _query_vector(m)).select("chunk_id", F.round("cosine", 6).alias("score"))


@query
def search_hybrid(m: Model) -> DataFrame:
    r = search.hybrid(m.chunks(), m.embedded(), TEXT, _query_vector(m))
    return r.withColumns({c: F.round(c, 6) for c in ("score", "bm25", "trigram", "cosine")})


@query
def search_progress(m: Model) -> DataFrame:
    return search.progress(m.chunks(), m.embedded())


@query
def search_document_frequency(m: Model) -> DataFrame:
    return search.document_frequency(m.chunks())


@query
def search_postings(m: Model) -> DataFrame:
    return search.postings(m.chunks())


def _merged(m: Model) -> DataFrame:
    return symbols.merge(m.code_chunks(), m.symbols())


_FOUND = ("file_path", "start_line", "name", "qualified_path", "score")


@query
def symbol_merge(m: Model) -> DataFrame:
    return _merged(m)


@query
def symbol_get_exact(m: Model) -> DataFrame:
    return symbols.get_symbol(_merged(m), "Brand2.small_ring").select(*_FOUND, "tier")


@query
def symbol_get_suffix(m: Model) -> DataFrame:
    return symbols.get_symbol(_merged(m), "small_ring").select(*_FOUND, "tier")


@query
def symbol_get_ci(m: Model) -> DataFrame:
    return symbols.get_symbol(_merged(m), "SMALL_R").select(*_FOUND, "tier")


@query
def symbol_get_fuzzy(m: Model) -> DataFrame:
    return symbols.get_symbol(_merged(m), "bsmrg").select(*_FOUND, "tier")


@query
def symbol_search_kind(m: Model) -> DataFrame:
    return symbols.search_symbol(_merged(m), "cust", "function").select(*_FOUND)


@query
def symbol_list_file(m: Model) -> DataFrame:
    return symbols.list_symbols(_merged(m), "src/n7.py")


_HIT = ("chunk_id", "file_path", "start_line", "n_matches")


@query
def grep_code(m: Model) -> DataFrame:
    return grep.grep(m.chunks(), "[Tt]h[aeiou]+n", limit=None).select(*_HIT)


@query
def grep_glob(m: Model) -> DataFrame:
    return grep.grep(m.chunks(), "licen[cs]ed?", ["EN", "fr"], "src1*/*").select(*_HIT)


@query
def grep_summary(m: Model) -> DataFrame:
    return grep.grep_summary(m.chunks(), "licen[cs]ed?", ["en", "fr"])


@query
def grep_positions(m: Model) -> DataFrame:
    return grep.positions(m.chunks(), "[Tt]h[aeiou]+n")


@query
def duplicates_workspace(m: Model) -> DataFrame:
    return duplicates.find_duplicates(m.vectors(), min_similarity=0.3, text_col=None).withColumn("similarity", F.round("similarity", 6))


def _embedded_chunks(m: Model) -> DataFrame:
    return m.chunks().join(m.embedded(), "chunk_id")


@query
def duplicates_text(m: Model) -> DataFrame:
    return duplicates.find_duplicates(_embedded_chunks(m), min_similarity=0.2).withColumn("similarity", F.round("similarity", 6))


@query
def duplicates_compared(m: Model) -> DataFrame:
    return duplicates.compared(_embedded_chunks(m))


@query
def duplicates_groups(m: Model) -> DataFrame:
    return duplicates.groups(duplicates.find_duplicates(m.vectors(), min_similarity=0.3, text_col=None)).withColumn("best", F.round("best", 6))


@query
def duplicates_file(m: Model) -> DataFrame:
    return duplicates.find_duplicates(m.vectors(), file="f3", min_similarity=0.3, text_col=None).withColumn("similarity", F.round("similarity", 6))


def _root(m: Model) -> DataFrame:
    return m.symbols().filter(F.col("name") == "Customer_000000007").select(F.col("symbol_id").alias("node_id"))


@query
def graph_outbound(m: Model) -> DataFrame:
    return graph.call_graph(_root(m), m.edges(), "outbound", 2)


@query
def graph_inbound(m: Model) -> DataFrame:
    return graph.call_graph(_root(m), m.edges(), "inbound", 2)


@query
def graph_both(m: Model) -> DataFrame:
    return graph.call_graph(_root(m), m.edges(), "both", 2)


@query
def graph_named(m: Model) -> DataFrame:
    root = graph.root_of("Customer_0000001", _merged(m), m.symbols())
    return graph.with_names(graph.call_graph(root, m.edges(), "outbound", 2), m.symbols()).select("edge_id", "caller_name", "caller_file", "callee_name", "callee_file", "source", "depth")


@query
def graph_locator(m: Model) -> DataFrame:
    return graph.call_graph(graph.locate(m.symbols(), "src/n5.py", 30, 6), m.edges(), "outbound", 2)


@query
def blast_radius(m: Model) -> DataFrame:
    return graph.blast_radius(m.symbols(), m.edges(), "src/n3.py")


@query
def blast_radius_totals(m: Model) -> DataFrame:
    return graph.blast_totals(graph.blast_radius(m.symbols(), m.edges(), "src/n3.py"))


def _positions(m: Model) -> DataFrame:
    o = m.table("orders")
    return o.select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("src/n"), F.col("o_custkey") % 25, F.lit(".py")).alias("file_path"), (F.col("o_orderkey") % 60).cast("int").alias("line"), "o_orderstatus")


def _live(m: Model) -> DataFrame:
    p = _positions(m).filter("o_orderstatus = 'P'")
    return p.select("query_id", "file_path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit("live").alias("symbol"), F.concat(F.lit("live "), "query_id").alias("contents"))


@query
def enclosing_symbol(m: Model) -> DataFrame:
    return layers.enclosing(_positions(m), m.symbols(), "symbol_id").select("query_id", "symbol_id", "name")


@query
def enclosing_chunk(m: Model) -> DataFrame:
    return layers.enclosing(_positions(m), m.code_chunks(), "chunk_id").select("query_id", "chunk_id", "symbol_path")


@query
def definition_cascade(m: Model) -> DataFrame:
    return layers.definition(_positions(m), _live(m), m.symbols(), m.code_chunks())


@query
def type_definition(m: Model) -> DataFrame:
    return layers.type_definition(_positions(m), _live(m), m.symbols(), m.code_chunks())


@query
def enrich_location(m: Model) -> DataFrame:
    return layers.enrich(_positions(m), m.symbols(), m.code_chunks())


@query
def include_source(m: Model) -> DataFrame:
    d = m.table("documents").filter("text IS NOT NULL")
    return d.select("doc_id", layers.source_lines(F.col("text"), F.lit(1), F.lit(3)).alias("source_text"))


@query
def references_symbol(m: Model) -> DataFrame:
    none = m.symbols().limit(0).select("file_path", "start_line", "end_line")
    return layers.references("src/n5.py", 4, none, m.symbols(), m.edges(), m.code_chunks())


def _lines(m: Model) -> DataFrame:
    return m.chunks().withColumn("end_line", F.col("start_line"))


@query
def references_word(m: Model) -> DataFrame:
    none = m.symbols().limit(0).select("file_path", "start_line", "end_line")
    first = _lines(m).agg(F.min(F.struct("file_path", "start_line")).alias("f")).first()["f"]
    return layers.references(first["file_path"], first["start_line"], none, m.symbols(), m.edges(), _lines(m), 40)


@query
def references_live(m: Model) -> DataFrame:
    live = m.symbols().filter(F.col("file_path") == "src/n7.py").select("file_path", "start_line", "end_line")
    return layers.references("src/n5.py", 4, live, m.symbols(), m.edges(), m.code_chunks(), 10)


@query
def workspace_symbols(m: Model) -> DataFrame:
    live = m.symbols().select("name", "kind", F.concat(F.lit("file:///ws/"), "file_path").alias("uri"), "start_line", F.lit(None).cast("string").alias("container"))
    return layers.workspace_symbols(live, "/ws").drop("container")


@query
def server_status(m: Model) -> DataFrame:
    s = m.table("supplier")
    return layers.server_status(s.select(F.col("s_name").alias("command"), F.when(F.col("s_nationkey") % 2 == 0, "running").otherwise("failed").alias("state"), (F.col("s_suppkey") % 6).cast("int").alias("attempts")))


@query
def hover_cascade(m: Model) -> DataFrame:
    return layers.hover(_positions(m), _live(m), m.symbols(), m.code_chunks())


@query
def inbound_calls(m: Model) -> DataFrame:
    return layers.inbound_calls(_positions(m), m.symbols(), m.edges())


@query
def incoming_calls(m: Model) -> DataFrame:
    live = _live(m).select("query_id", F.col("contents").alias("name"), "file_path", F.lit(1).cast("long").alias("n_sites"))
    return layers.incoming(_positions(m), live, m.symbols(), m.edges()).withColumn("n_sites", F.col("n_sites").cast("long"))


@query
def code_actions(m: Model) -> DataFrame:
    p = _positions(m)
    live = p.filter("o_orderstatus = 'P'").select("query_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).withColumn("title", F.concat(F.lit("fix "), "n")).withColumn("edit", F.lit(None).cast("string"))
    resolved = live.filter("n = 0 AND query_id % 2 = 0").withColumn("edit", F.concat(F.lit("e"), "query_id"))
    return layers.code_actions(p, live, resolved)


@query
def rename_edits(m: Model) -> DataFrame:
    p = _positions(m)
    prepared = p.filter("o_orderstatus <> 'F'").select("query_id", F.concat(F.lit("p"), "line").alias("placeholder"))
    return layers.rename_edits(p, prepared, p.filter("query_id % 3 <> 0").select("query_id", F.concat(F.lit("e"), "query_id").alias("edit")))


@query
def references_index(m: Model) -> DataFrame:
    return layers.references_index(_positions(m), m.symbols(), m.edges())


@query
def references_text(m: Model) -> DataFrame:
    return layers.references_text("disgusting", m.chunks()).select("chunk_id", "file_path", "start_line")


@query
def references_by_file(m: Model) -> DataFrame:
    hits = m.chunks().filter(F.col("text").ilike("%worthless%")).select("file_path", "start_line")
    return layers.by_file(hits, 20)


@query
def implementations(m: Model) -> DataFrame:
    return layers.implementations("Customer_000000011", m.symbols(), m.code_chunks())


@query
def longest_identifier(m: Model) -> DataFrame:
    line = F.concat_ws(" ", "event_type", "props", F.concat(F.lit("user_"), "user_id"))
    return m.table("events").select("event_id", layers.longest_identifier(line).alias("identifier"))


def _index(m: Model) -> DataFrame:
    """An older state of the files: some changed, some gone, some new since."""
    d = m.table("documents").filter("lang <> 'es'")
    path, h, n = F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang"), F.substring(F.sha2("text", 256), 1, 32), F.col("n_chars")
    a = d.select(path.alias("file_path"), F.when(n > 2000, F.reverse(h)).otherwise(h).alias("content_hash"), F.octet_length("text").cast("long").alias("file_size"), (n % 2 == 0).alias("ts_indexed"), (n % 3 == 0).alias("lsp_indexed"), (n % 5 == 0).alias("embedded"))
    p = m.table("pages")
    b = p.select(F.concat(F.lit("gone/"), "page_id", F.lit(".html")).alias("file_path"), F.substring(F.sha2("html", 256), 1, 32).alias("content_hash"), F.octet_length("html").cast("long").alias("file_size"), F.lit(True).alias("ts_indexed"), F.lit(True).alias("lsp_indexed"), F.lit(False).alias("embedded"))
    return a.unionByName(b)


@query
def reconcile_diff(m: Model) -> DataFrame:
    return maintain.reconcile(m.files(), _index(m))


@query
def reconcile_stats(m: Model) -> DataFrame:
    return maintain.reconcile_stats(maintain.reconcile(m.files(), _index(m)))


@query
def dirty_drain(m: Model) -> DataFrame:
    return maintain.dirty(_index(m), "treesitter")


@query
def mark_dirty(m: Model) -> DataFrame:
    return maintain.mark_dirty(_index(m), m.files())


def _some_files(m: Model) -> DataFrame:
    return _index(m).filter(F.endswith("file_path", F.lit(".fr"))).select("file_path")


@query
def mark_indexed(m: Model) -> DataFrame:
    return maintain.mark_indexed(_index(m), _some_files(m), "lsp").select("file_path", "ts_indexed", "lsp_indexed", "embedded")


@query
def mark_parsed(m: Model) -> DataFrame:
    return maintain.parsed(_index(m), _some_files(m)).select("file_path", "ts_indexed", "lsp_indexed", "embedded")


@query
def chunk_replace(m: Model) -> DataFrame:
    c = m.code_chunks().select("chunk_id", "file_path", "start_line", "symbol_path")
    files = m.spark.createDataFrame([("src/n1.py",), ("src/n2.py",), ("src/none.py",)], "file_path string")
    fresh = c.filter(F.col("file_path") == "src/n1.py").withColumn("chunk_id", -F.col("chunk_id"))
    return maintain.replace_chunks(c, files, fresh)


@query
def edge_replace(m: Model) -> DataFrame:
    e = m.edges().drop("from_ranges")
    files = m.spark.createDataFrame([("src/n1.py",), ("src/n2.py",)], "file_path string")
    fresh = e.filter((F.col("file_path") == "src/n1.py") & (F.col("source") == "treesitter")).withColumn("edge_id", -F.col("edge_id"))
    return maintain.replace_edges(e, files, fresh)


@query
def outgoing_calls(m: Model) -> DataFrame:
    o = m.table("orders")
    n = m.table("customer").agg(F.count("*").alias("n"))
    to = m.symbols().select(F.col("symbol_id").alias("to"), F.col("file_path").alias("callee_file"), F.col("start_line").alias("callee_line"))
    calls = o.crossJoin(F.broadcast(n)).select(F.col("o_custkey").alias("caller_id"), ((F.col("o_orderkey") * 7 + 3) % F.col("n")).alias("to")).join(to, "to").select("caller_id", "callee_file", "callee_line")
    files = m.symbols().select("file_path").distinct().filter("file_path <> 'src/n3.py'")
    return edges.outgoing(calls, m.symbols(), files)


@query
def watcher_accept(m: Model) -> DataFrame:
    d = m.table("documents")
    path = F.concat(F.when(F.col("doc_id") % 5 == 0, "/other/").otherwise("/ws/"), F.when(F.col("doc_id") % 7 == 0, ".git/").otherwise(""), "source", F.lit("/"), "doc_id", F.lit("."), "lang")
    rules = tree.ignore_rules(m.spark, {"": "*.fr\n!src1/*.fr\nsrc2/\n"})
    return events.accepted(d.select(F.col("doc_id").alias("seq"), path.alias("path")), ["en", "fr", "de"], "/ws", rules)


@query
def root_overlap(m: Model) -> DataFrame:
    inner = m.table("pages").select(F.regexp_extract("url", "^https?://([^?]*)/[^/?]*", 1).alias("root")).distinct()
    wanted = inner.agg(F.min("root")).first()[0] or ""
    return tree.overlapping(inner, wanted)


@query
def git_range(m: Model) -> DataFrame:
    o = m.table("orders")
    code = F.element_at(F.array(*map(F.lit, ("A", "M", "D", "R090", "C100", "T"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    old = F.when(F.col("o_orderkey") % 6 >= 3, "old.py\t").otherwise("")
    path = F.concat(F.lit("src/f"), "o_custkey", F.when(F.col("o_custkey") % 2 == 0, ".py").otherwise(".txt"))
    return tree.scope(tree.changed(o.select(F.col("o_orderkey").alias("position"), F.concat(code, F.lit("\t"), old, path).alias("line"))), ["py"])


@query
def glob_scope(m: Model) -> DataFrame:
    return tree.scope(tree.matching(m.files(), "src?/1*.[ef]*"), ["en", "fr"]).select("path")


@query
def search_cosine_mismatch(m: Model) -> DataFrame:
    q = _query_vector(m).select(F.slice("q", 1, 8).alias("q"))
    return search.cosine(m.embedded(), q).select("chunk_id", F.round("cosine", 6).alias("score"))


@query
def manager_readiness(m: Model) -> DataFrame:
    return maintain.manager_ready(m.table("supplier").select((F.col("s_suppkey") >= 0).alias("ready")))


def _ranked(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _symbol_roots(m: Model) -> dict:
    """A context for each kind of symbol, one of which has no table."""
    def of(kind: str):
        found = symbols.search_symbol(_merged(m).filter(F.col("meta") == kind), "cust", None, 50)
        return _ranked(found.select("name", "score", "file_path", "start_line"), F.desc("score"), "file_path", "start_line")

    return {**{k: lambda k=k: of(k) for k in ("function", "method", "type")}, "broken": lambda: m.table("no_such_table")}


@query
def fanout_symbols(m: Model) -> DataFrame:
    return fanout.fan_out(m.spark, _symbol_roots(m), 30)[0].select("root", "name", "score", "rank", "position")


@query
def fanout_failures(m: Model) -> DataFrame:
    return fanout.fan_out(m.spark, _symbol_roots(m), 30)[1].select("root")


@query
def fanout_grep(m: Model) -> DataFrame:
    def of(lang: str, pattern: str):
        return _ranked(grep.grep(m.chunks(), pattern, [lang], None, 50).select("chunk_id", "file_path", "start_line"), "file_path", "start_line", "chunk_id")

    found = fanout.fan_out(m.spark, {"en": lambda: of("en", "licen[cs]ed?"), "fr": lambda: of("fr", "licen[cs]ed?"), "de": lambda: of("de", "(")}, 40)[0]
    return found.select("root", "chunk_id", "rank", "position")


@query
def drain_batches(m: Model) -> DataFrame:
    return maintain.batches(_index(m), "lsp")


@query
def drain_outcomes(m: Model) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("done", "unsafe", "unreadable", "error"))), (F.length("file_path") % 4 + 1).cast("int"))
    return maintain.settle_outcomes(_index(m), _index(m).select("file_path", kinds.alias("outcome")), "lsp").select("file_path", "lsp_indexed")


def _extracted(m: Model) -> dict[str, DataFrame]:
    s, e = m.symbols(), m.edges().select("edge_id", "caller_id", "callee_id", "file_path", "source")
    fresh = s.filter("file_path IN ('src/n1.py', 'src/n2.py') AND kind <> 'struct'").withColumn("name", F.upper("name")).withColumn("symbol_id", -F.col("symbol_id") - 1)
    # one symbol a place, as the identity is
    fresh = fresh.groupBy("file_path", "start_line").agg(F.max_by(F.struct(*[c for c in fresh.columns if c not in ("file_path", "start_line")]), "symbol_id").alias("r")).select("file_path", "start_line", "r.*")
    again = e.filter("file_path = 'src/n1.py' AND source = 'lsp'").withColumn("edge_id", -F.col("edge_id"))
    files = s.select("file_path").distinct().select("file_path", *[F.lit(True).alias(f) for f in maintain.FLAGS.values()])
    one = s.groupBy("file_path", "start_line").agg(F.max_by(F.struct(*[c for c in s.columns if c not in ("file_path", "start_line")]), "symbol_id").alias("r")).select("file_path", "start_line", "r.*")
    return maintain.re_extract(one, fresh, e, again, files)


@query
def re_extract_symbols(m: Model) -> DataFrame:
    return _extracted(m)["symbols"].select("symbol_id", "name", "file_path", "start_line")


@query
def re_extract_edges(m: Model) -> DataFrame:
    return _extracted(m)["edges"]


@query
def re_extract_files(m: Model) -> DataFrame:
    return _extracted(m)["files"].select("file_path", "lsp_indexed")


@query
def server_ready(m: Model) -> DataFrame:
    e = m.table("events")
    code = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, -32801).when(F.col("event_id") % 3 == 1, -32802).otherwise(-32603))
    return events.server_ready(e.select(F.concat(F.lit("s"), F.col("user_id") % 200).alias("server"), "ts", F.col("event_id").alias("seq"), code.alias("error_code")))


@query
def mark_uncovered(m: Model) -> DataFrame:
    return maintain.mark_uncovered(_index(m), ["en", "fr"]).select("file_path", "lsp_indexed")


@query
def rebuild_index(m: Model) -> DataFrame:
    return maintain.rebuild(_index(m), "lsp").select("file_path", "ts_indexed", "lsp_indexed", "embedded")


@query
def index_status(m: Model) -> DataFrame:
    s = maintain.status(_index(m), m.code_chunks(), m.symbols(), m.edges())
    return s.withColumns({c: F.round(c, 6) for c in s.columns if c.endswith("_percent")})


@query
def cascade_delete(m: Model) -> DataFrame:
    gone = m.spark.createDataFrame([("src/n1.py",), ("src/n2.py",)], "file_path string")
    left = maintain.cascade_delete(gone, m.code_chunks(), m.symbols(), m.edges())
    a, b, c = (left[k].agg(F.count("*").alias(k)) for k in ("chunks", "symbols", "edges"))
    return a.crossJoin(b).crossJoin(c)


@query
def lsp_invalidation(m: Model) -> DataFrame:
    s = m.symbols()
    return maintain.invalidated(maintain.vanished(s, s.filter("kind <> 'struct'")), m.edges())


@query
def corpus_signature_diff(m: Model) -> DataFrame:
    c = m.chunks().select("chunk_id", "file_path", "kind")
    old = maintain.signatures(c.join(m.embedded(), "chunk_id", "left"))
    new = maintain.signatures(c.filter("kind <> 'other'").withColumn("embedding", F.lit(None).cast("array<double>")))
    return maintain.signature_diff(old, new)


@query
def embed_drain(m: Model) -> DataFrame:
    e = m.table("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    stale = e.withColumn("embedding", F.slice("embedding", 1, 8))
    done = maintain.drain_embeddings(stale, e, 64)
    return done.select("chunk_id", F.size("embedding").cast("long").alias("dims"), F.round(search.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


@query
def readiness(m: Model) -> DataFrame:
    i = _index(m).agg(F.count("*").alias("walked"), F.count_if("ts_indexed").alias("parsed"), F.count_if("embedded").alias("embedded"), F.count_if("lsp_indexed").alias("lsp_indexed"))
    servers = m.spark.createDataFrame([("running", 0), ("notFound", 0), ("failed", 5)], "state string, attempts int")
    return maintain.readiness(i, servers)


@query
def fanout_interleave(m: Model) -> DataFrame:
    c = m.chunks()
    root = F.regexp_extract("file_path", r"\.([^.]+)$", 1)
    hits = search.bm25(c, TEXT).join(c.select("chunk_id", root.alias("root")), "chunk_id")
    w = Window.partitionBy("root").orderBy(F.desc(F.round("bm25", 9)), "chunk_id")
    return dg.interleave(hits.select("root", "chunk_id", F.row_number().over(w).alias("rank")), 50)


def _projects(m: Model) -> DataFrame:
    names = ("Package.swift", "Cargo.toml", "x.csproj", "package.json", "go.mod", "README", "Makefile")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return languages.detect_projects(m.table("part").select(F.concat(F.lit("p"), "p_size").alias("dir"), name.alias("name")))


@query
def project_detection(m: Model) -> DataFrame:
    return _projects(m)


@query
def server_specs(m: Model) -> DataFrame:
    return languages.server_specs(_projects(m))


def _hosts(m: Model) -> DataFrame:
    return m.table("pages").filter(F.contains("url", F.lit("/en/"))).select(F.regexp_extract("url", "^https?://([^/?]*)", 1).alias("path")).distinct()


@query
def root_discovery(m: Model) -> DataFrame:
    inner = m.table("pages").select(F.regexp_extract("url", "^https?://([^?]*)/[^/?]*", 1).alias("path"))
    return tree.roots(inner.unionByName(_hosts(m)))


@query
def enclosing_root(m: Model) -> DataFrame:
    paths = m.table("pages").select(F.regexp_extract("url", "^https?://([^?]*)", 1).alias("path")).distinct()
    return tree.enclosing_root(paths, _hosts(m).withColumnRenamed("path", "root"))


@query
def gitignore_filter(m: Model) -> DataFrame:
    files = m.files().select(F.col("file_path").alias("path"), F.lit(False).alias("is_dir"))
    folders = files.select(F.substring_index("path", "/", 1).alias("path"), F.lit(True).alias("is_dir")).distinct()
    rules = tree.ignore_rules(m.spark, {"": "# comment\n*.fr\n!src1/*.fr\nsrc2/\n", "src3": "/1*\n"})
    return tree.visible(files.unionByName(folders), rules)


@query
def extension_filter(m: Model) -> DataFrame:
    return tree.known_extension(m.files(), only=["en", "de"])


@query
def git_scopes(m: Model) -> DataFrame:
    o = m.table("orders")
    code = F.element_at(F.array(*map(F.lit, ("??", " M", "M ", "A ", "R ", "D ", "UU", "AM", "MD"))), (F.col("o_orderkey") % 9 + 1).cast("int"))
    path = F.concat(F.when(F.startswith("o_orderpriority", F.lit("5")), "../").otherwise("src/"), F.lit("f"), "o_custkey", F.when(F.col("o_custkey") % 2 == 0, ".py").otherwise(".txt"))
    line = F.concat(code, F.lit(" "), F.when(F.col("o_orderkey") % 9 == 4, "old.py -> ").otherwise(""), path)
    return tree.scope(tree.porcelain(o.select(F.col("o_orderkey").alias("position"), line.alias("line"))), ["py"])


def _targets(m: Model) -> DataFrame:
    return m.spark.createDataFrame([("src/n1.py", 0), ("src/n2.py", 1)], "file_path string, ord int")


@query
def diagnostics_report(m: Model) -> DataFrame:
    return dg.report(m.diagnostics(), _targets(m), dg.dependents(m.symbols(), m.edges(), _targets(m)))


@query
def diagnostics_totals(m: Model) -> DataFrame:
    return dg.totals(dg.report(m.diagnostics(), _targets(m), dg.dependents(m.symbols(), m.edges(), _targets(m))))


@query
def diagnostics_dependents(m: Model) -> DataFrame:
    return dg.dependents(m.symbols(), m.edges(), _targets(m))


@query
def diagnostics_cache(m: Model) -> DataFrame:
    return events.latest(m.file_events(), "path", "kind")


@query
def watcher_debounce(m: Model) -> DataFrame:
    return events.debounce(m.file_events(), 600_000)


@query
def settle_outcome(m: Model) -> DataFrame:
    e = m.table("events").withColumn("since", events.millis(m.table("events"), "ts") - 1_704_067_200_000)  # since the start of 2024
    u = e.select(F.col("user_id").alias("request"), F.expr("since div 1000").alias("at_ms"))
    return events.settle(u, 60_000, 2_000_000)


@query
def doc_version_sync(m: Model) -> DataFrame:
    e = m.table("events")
    return events.versions(e.select(F.col("event_id").alias("seq"), "ts", F.concat(F.lit("u"), "user_id").alias("path"), F.floor(F.col("value") / 10).alias("hash")))


def _sites(m: Model) -> DataFrame:
    n = m.table("part").agg(F.count("*").alias("n"))
    o = m.table("orders").crossJoin(F.broadcast(n)).withColumn("p_partkey", F.col("o_orderkey") % F.col("n"))
    name = F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))
    return o.join(m.table("part"), "p_partkey").select(F.col("o_orderkey").alias("site_id"), F.concat(F.lit("src/n"), F.col("o_custkey") % 25, F.lit(".py")).alias("file_path"), F.floor(F.col("o_custkey") / 25).cast("int").alias("line"), name.alias("name"))


@query
def call_edge_resolution(m: Model) -> DataFrame:
    return edges.resolve(_sites(m), m.code_chunks())


@query
def call_edge_emit(m: Model) -> DataFrame:
    """Names in several cases, with and without a dot, to edges between symbols."""
    leaf, kind = F.substring_index("symbol_path", ".", -1), F.col("chunk_id") % 4
    chunks = m.code_chunks().withColumn("symbol_path", F.when(kind == 0, F.upper(leaf)).when(kind == 1, leaf).otherwise(F.concat(F.lit("X."), leaf)))
    places = chunks.groupBy("file_path", "start_line").agg(F.min("chunk_id").alias("symbol_id"))
    sites = _sites(m).withColumn("name", F.when(F.col("site_id") % 2 == 0, F.lower("name")).otherwise(F.col("name")))
    return edges.emit(sites, chunks, places)


@query
def ensure_symbols(m: Model) -> DataFrame:
    return edges.ensure_symbols(m.symbols(), m.code_chunks())


@query
def ast_query(m: Model) -> DataFrame:
    return edges.query_nodes(edges.with_parents(m.nodes()), "(ul (li (a) @link))", limit=None)


@query
def ast_siblings(m: Model) -> DataFrame:
    return edges.query_nodes(edges.with_parents(m.nodes()), "(ul (li) @first (li (a) @link))", limit=None)


@query
def ast_progress(m: Model) -> DataFrame:
    nodes = edges.with_parents(m.nodes())
    return edges.query_progress(nodes, m.table("pages").select(F.col("page_id").alias("file")), "(ul (li (a) @link))", 200)


@query
def flatten_symbols(m: Model) -> DataFrame:
    return edges.flatten(edges.with_parents(m.nodes()))


@query
def path_safety(m: Model) -> DataFrame:
    p = m.table("pages").select("page_id", F.regexp_replace("url", "^https?:/", "").alias("path"))
    p = p.withColumn("path", F.when(F.col("page_id") % 3 == 0, F.expr("substring(path, 2)")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("a/../b"), "path")).otherwise(F.col("path")))
    return p.select("page_id", safe_path(F.col("path")).alias("safe"))

