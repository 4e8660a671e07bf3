"""Position look-ups that fall from live answers to the symbol index to parsed chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAYERS = ("liveLSP", "lspIndex", "treeSitter")


#: Lines of a stripe; spans are listed under every stripe that they touch.
STRIPE = 32


def _narrowest(places: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """The narrowest span at each of the distinct places (file_path, line): _file, _line and the span's columns.

    The join is by file and stripe of lines, so a long file isn't compared with all
    of its spans.  The window has the join's keys, so what it drops isn't shuffled.
    """
    p = places.select(F.col("file_path").alias("_file"), F.col("line").alias("_line")).distinct().withColumn("_s", F.floor(F.col("_line") / STRIPE)).alias("p")
    s = spans.withColumn("_s", F.explode(F.sequence(F.floor(F.col("start_line") / STRIPE), F.floor(F.col("end_line") / STRIPE)))).alias("s")
    hit = p.join(s, (F.col("_file") == F.col("s.file_path")) & (F.col("p._s") == F.col("s._s")) & (F.col("s.start_line") <= F.col("_line")) & (F.col("s.end_line") >= F.col("_line"))).select("_file", "p._s", "_line", *[F.col(f"s.{c}") for c in spans.columns])
    w = Window.partitionBy("_file", "_s", "_line").orderBy(F.col("end_line") - F.col("start_line"), key)
    return hit.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_s")


def enclosing(positions: DataFrame, spans: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each position (query_id, file_path, line) its narrowest span: query_id, the span's columns, and the position's columns of `keep` as at_....

    Each place is looked up once, however many positions lie there, and a position
    meets one span; a window keeps one row of a query that has several places.
    """
    at = positions.select("query_id", F.col("file_path").alias("_at"), F.col("line").alias("_on"), *[F.col(c).alias(f"at_{c}") for c in keep])
    best = _narrowest(positions, spans, key)
    hit = at.join(best, (F.col("_at") == F.col("_file")) & (F.col("_on") == F.col("_line"))).select("query_id", *[f"at_{c}" for c in keep], *spans.columns)
    w = Window.partitionBy("query_id").orderBy(F.col("end_line") - F.col("start_line"), key)
    # shuffled first: else the rows are also sorted before that, to no end
    return hit.repartition("query_id").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def cascade(positions: DataFrame, *answers: DataFrame) -> DataFrame:
    """For every query the rows of the first layer that has any, with `layer`; `none` where no layer has.

    Each of `answers` (live, index, parsed) has query_id and equal columns.
    """
    both = None
    for k, a in enumerate(answers):
        a = a.withColumn("_layer", F.lit(k))
        both = a if both is None else both.unionByName(a)
    best = F.min("_layer").over(Window.partitionBy("query_id"))  # a join would work out all answers twice
    rows = both.withColumn("_best", best).filter("_layer = _best").drop("_best")
    # not element_at: with an index that may be null the planner still takes it as never null, and drops the default
    name = F.when(F.col("_layer") == 0, LAYERS[0]).when(F.col("_layer") == 1, LAYERS[1]).when(F.col("_layer") == 2, LAYERS[2]).otherwise("none")
    return positions.select("query_id").join(rows, "query_id", "left").withColumn("layer", name).drop("_layer")


_PLACE = ("query_id", "file_path", "start_line", "end_line", "symbol")


def _places(positions: DataFrame, symbols: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = enclosing(positions, symbols, "symbol_id").withColumn("symbol", F.col("name"))
    c = enclosing(positions, chunks, "chunk_id").withColumn("symbol", F.col("symbol_path"))
    return s.select(*_PLACE), c.select(*_PLACE)


def definition(positions: DataFrame, live: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Live locations, else the narrowest symbol, else the narrowest chunk."""
    return cascade(positions, live.select(*_PLACE), *_places(positions, symbols, chunks))


def type_definition(positions: DataFrame, live: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Like `definition`, with the live answers of a type request."""
    return definition(positions, live, symbols, chunks)


def hover(positions: DataFrame, live: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, contents and layer: live contents, else detail or `name (kind)`, else the chunk's text."""
    s = enclosing(positions, symbols, "symbol_id").select("query_id", F.coalesce("detail", F.concat("name", F.lit(" ("), "kind", F.lit(")"))).alias("contents"))
    c = enclosing(positions, chunks, "chunk_id").select("query_id", F.col("text").alias("contents"))
    return cascade(positions, live.select("query_id", "contents"), s, c)


def code_actions(requests: DataFrame, live: DataFrame, resolved: DataFrame) -> DataFrame:
    """query_id, n, title, edit and layer: the live actions (query_id, n, title, edit) of each request, as they were resolved (the same columns) or, where that failed, as they came; `none` without any."""
    r = resolved.select("query_id", "n", F.col("title").alias("_title"), F.col("edit").alias("_edit"), F.lit(True).alias("_has"))
    both = live.join(r, ["query_id", "n"], "left").select("query_id", "n", F.when(F.col("_has"), F.col("_title")).otherwise(F.col("title")).alias("title"), F.when(F.col("_has"), F.col("_edit")).otherwise(F.col("edit")).alias("edit"))
    return requests.select("query_id").join(both, "query_id", "left").withColumn("layer", F.when(F.col("n").isNotNull(), LAYERS[0]).otherwise("none"))


def rename_edits(requests: DataFrame, prepared: DataFrame, edits: DataFrame) -> DataFrame:
    """query_id, can_rename, placeholder and edit: a rename counts only where the server prepared it (query_id, placeholder) and gave an edit (query_id, edit)."""
    p = prepared.select("query_id", "placeholder", F.lit(True).alias("_p"))
    both = requests.select("query_id").join(p, "query_id", "left").join(edits.select("query_id", "edit"), "query_id", "left")
    can = F.coalesce(F.col("_p") & F.col("edit").isNotNull(), F.lit(False))
    return both.select("query_id", can.alias("can_rename"), F.when(can, F.col("placeholder")).alias("placeholder"), F.when(can, F.col("edit")).alias("edit"))


def incoming(positions: DataFrame, live: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """The callers (query_id, name, file_path, n_sites, layer) of what lies at each position: live ones, else those of the index.

    The callers come last, to the positions that have no live answer, so they aren't shuffled.
    """
    columns = ("name", "file_path", "n_sites")
    told = positions.select("query_id").join(live.select("query_id", *columns), "query_id").withColumn("layer", F.lit(LAYERS[0]))
    at = enclosing(positions, symbols, "symbol_id").select("query_id", F.col("symbol_id").alias("_callee"))
    rest = positions.select("query_id").join(live.select("query_id"), "query_id", "left_anti").join(at, "query_id", "left")
    # positions without a symbol are spread over the join's tasks
    rest = rest.withColumn("_salt", F.when(F.col("_callee").isNull(), F.pmod(F.xxhash64("query_id"), F.lit(1024))).otherwise(F.lit(0).cast("long")))
    c = _callers(positions, symbols, edges).withColumn("_zero", F.lit(0).cast("long"))
    found = rest.join(c, (F.col("_callee") == F.col("callee_id")) & (F.col("_salt") == F.col("_zero")), "left")
    layer = F.when(F.col("callee_id").isNotNull(), LAYERS[1]).otherwise("none").alias("layer")
    return told.unionByName(found.select("query_id", *columns, layer))


def call_sites(ranges):
    """The 4-number ranges of a JSON text; anything else is dropped, invalid JSON is empty."""
    return F.coalesce(F.filter(F.from_json(ranges, "array<array<int>>"), lambda q: F.size(q) == 4), F.array())


def _callers(positions: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """caller_id, callee_id, n_sites, name and file_path: the callers of each symbol that is the narrowest at a place; counted once, not for every position."""
    asked = _narrowest(positions, symbols, "symbol_id").select(F.col("symbol_id").alias("callee_id")).distinct()
    e = edges.join(asked, "callee_id", "left_semi").select("caller_id", "callee_id", F.size(call_sites(F.col("from_ranges"))).alias("n"))
    n = e.groupBy("callee_id", "caller_id").agg(F.sum("n").alias("n_sites"))
    return n.join(symbols.select(F.col("symbol_id").alias("caller_id"), "name", "file_path"), "caller_id")


def inbound_calls(positions: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, caller_id, name, file_path, n_sites: the callers of the symbol at each position."""
    at = enclosing(positions, symbols, "symbol_id").select("query_id", F.col("symbol_id").alias("callee_id"))
    return at.join(_callers(positions, symbols, edges), "callee_id").select("caller_id", "query_id", "n_sites", "name", "file_path")


def references_index(positions: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, file_path, start_line: call sites in callers, or the caller's range where an edge has none."""
    at = enclosing(positions, symbols, "symbol_id").select("query_id", F.col("symbol_id").alias("callee_id"))
    e = edges.select("caller_id", "callee_id", F.col("file_path").alias("site_file"), call_sites(F.col("from_ranges")).alias("sites"))
    hit = at.join(e, "callee_id").join(symbols.select(F.col("symbol_id").alias("caller_id"), F.col("file_path").alias("caller_file"), F.col("start_line").alias("caller_line")), "caller_id")
    site = hit.select("query_id", "caller_file", "caller_line", "site_file", F.explode_outer("sites").alias("r"))
    none = F.col("r").isNull()
    return site.select("query_id", F.when(none, F.col("caller_file")).otherwise(F.col("site_file")).alias("file_path"), F.when(none, F.col("caller_line")).otherwise(F.col("r")[0]).alias("start_line"))


def longest_identifier(line):
    """The longest identifier of a line, the first of equals; null if none."""
    words = F.filter(F.split(line, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike(r"^[\p{L}_]"))
    return F.aggregate(words, F.lit(None).cast("string"), lambda best, w: F.when(best.isNull() | (F.length(w) > F.length(best)), w).otherwise(best))


def references_text(word: str, chunks: DataFrame, limit: int = 200) -> DataFrame:
    """The chunks that hold a word in any case (`%` and `_` stay live), by file and line."""
    return chunks.filter(F.col("text").ilike(f"%{word}%")).orderBy("file_path", "start_line", "chunk_id").limit(limit)


def references(file: str, line: int, live: DataFrame, symbols: DataFrame, edges: DataFrame, chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """file_path, start_line, symbol, layer and total: the references to what lies at one position.

    Live locations (file_path, start_line, end_line); else the call sites of the symbol's
    callers; else, with the longest identifier of the position's line in its narrowest
    chunk, the chunks that hold it (three times `limit` are looked at, or 200).  `total` counts
    before the cut to `limit`; each reference has the symbol around it.
    """
    spark = chunks.sparkSession
    at = spark.createDataFrame([(0, file, line)], "query_id int, file_path string, line int")
    answers = [live.select("file_path", "start_line"), references_index(at, symbols, edges).select("file_path", "start_line")]
    inside = enclosing(at, chunks, "chunk_id").select(longest_identifier(F.get(F.split("text", "\n"), F.lit(line) - F.col("start_line"))).alias("word")).first()
    if inside and inside["word"]:
        answers.append(references_text(inside["word"], chunks, 200 if limit is None else 3 * limit).select("file_path", "start_line"))
    both = None
    for k, a in enumerate(answers):
        a = a.select("file_path", F.col("start_line").cast("int").alias("start_line"), F.lit(k).alias("_layer"))
        both = a if both is None else both.unionByName(a)
    best = both.agg(F.min("_layer").alias("_best"))
    rows = both.join(F.broadcast(best), F.col("_layer") == F.col("_best")).drop("_best")
    total = rows.agg(F.count("*").alias("total"))
    if limit is not None:
        rows = rows.orderBy("file_path", "start_line").limit(limit)
    rows = rows.groupBy("file_path", "start_line", "_layer").agg(F.count("*").alias("_n")).withColumn("query_id", F.struct("file_path", "start_line"))
    named = enrich(rows.select("query_id", "file_path", F.col("start_line").alias("line")), symbols, chunks)
    name = F.when(F.col("_layer") == 0, LAYERS[0]).when(F.col("_layer") == 1, LAYERS[1]).otherwise(LAYERS[2]).alias("layer")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    return rows.join(named, "query_id").crossJoin(F.broadcast(total)).select("file_path", "start_line", "symbol", name, "total")


def workspace_symbols(live: DataFrame, root: str) -> DataFrame:
    """The symbols that a live session found (name, kind, uri, start_line, container), with paths below the root; without a session there is none."""
    path = F.when(F.startswith("uri", F.lit(f"file://{root}/")), F.substring("uri", len(f"file://{root}/") + 1, 1 << 30)).otherwise(F.regexp_replace("uri", "^file://", ""))
    return live.select("name", "kind", path.alias("file_path"), "start_line", "container")


def server_status(servers: DataFrame) -> DataFrame:
    """command, state and attempts of every managed server, by command."""
    return servers.select("command", "state", "attempts").orderBy("command")


def implementations(name: str, symbols: DataFrame, chunks: DataFrame, limit: int = 20) -> DataFrame:
    """The symbol itself, else chunks with `impl <name>`; file_path, start_line and layer."""
    s = symbols.filter(F.col("name") == name).select("file_path", "start_line", F.lit(0).alias("_l"))
    c = chunks.filter(F.col("text").ilike(f"%impl {name}%")).select("file_path", "start_line", F.lit(1).alias("_l"))
    both = s.unionByName(c)
    best = both.agg(F.min("_l").alias("_b"))
    layer = F.when(F.col("_l") == 0, "lspIndex").otherwise("treeSitter").alias("layer")
    return both.join(F.broadcast(best), F.col("_l") == F.col("_b")).select("file_path", "start_line", layer).orderBy("file_path", "start_line").limit(limit)


def by_file(references: DataFrame, limit: int) -> DataFrame:
    """file_path and n of the first `limit` references, with `total` before that cut."""
    total = references.agg(F.count("*").alias("total"))
    return references.orderBy("file_path", "start_line").limit(limit).groupBy("file_path").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))


def enrich(locations: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id with the symbol at a location, else the chunk, else null."""
    s, c = _places(locations, symbols, chunks)
    return locations.select("query_id").join(s.select("query_id", F.col("symbol").alias("a")), "query_id", "left").join(c.select("query_id", F.col("symbol").alias("b")), "query_id", "left").select("query_id", F.coalesce("a", "b").alias("symbol"))


def source_lines(content, start, end):
    """The whole lines of a zero-based range."""
    return F.array_join(F.slice(F.split(content, "\n"), start + 1, end - start + 1), "\n")
