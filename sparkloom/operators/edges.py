"""Call edges from call sites, and queries over syntax nodes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import with_rank
from ..functions.text import leaf
from ..plans.session import forget, shared, shared_path
from .layers import enclosing


class QueryError(ValueError):
    """The node query can't be read."""


def resolve(sites: DataFrame, chunks: DataFrame) -> DataFrame:
    """`located` without the places that the sites and callers have."""
    return located(sites, chunks).select("site_id", "caller_path", "callee_file", "callee_path", "callee_line")


def located(sites: DataFrame, chunks: DataFrame) -> DataFrame:
    """One edge at most for each call site (site_id, file_path, line, name): site_id, file_path, line, caller_path, caller_line, callee_file, callee_path, callee_line.

    The caller is the narrowest chunk around the site.  A callee's path is the name, or
    ends in it after a dot in any case; it isn't the caller itself.  Candidates
    are ordered by same file first, then file and line.  Dotted candidates fit a name in
    any case, undotted ones only their own path, so these are ranked for each path and those
    for each lower-cased leaf.  Of either, only one (file, path) is ever excluded (the caller),
    so the first two, and the first two in each file, are enough.
    """
    c = chunks.select("chunk_id", "file_path", "start_line", "end_line", "symbol_path")
    named = c.select(F.lower(leaf(F.col("symbol_path"))).alias("key"), F.contains(F.col("symbol_path"), F.lit(".")).alias("dotted"), "file_path", "start_line", "symbol_path")
    named = named.groupBy("key", "dotted", "file_path", "symbol_path").agg(F.min("start_line").alias("start_line"))
    order = [F.col("start_line"), F.col("symbol_path")]
    group = ["key", "dotted", F.when(~F.col("dotted"), F.col("symbol_path"))]
    near = named.withColumn("n", F.row_number().over(Window.partitionBy(*group, "file_path").orderBy(*order))).filter("n <= 2")
    far = named.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("file_path", *order))).filter("n <= 2")
    at = sites.select(F.col("site_id").alias("query_id"), "file_path", "line", "name")
    caller = enclosing(at, c, "chunk_id", ("file_path", "name", "line"))
    caller = caller.select(F.col("query_id").alias("site_id"), F.col("at_file_path").alias("file_path"), F.col("at_name").alias("name"), F.col("at_line").alias("line"), F.lower("at_name").alias("key"), F.col("symbol_path").alias("caller_path"), F.col("start_line").alias("caller_line"))
    fits = F.col("dotted") | (F.col("symbol_path") == F.col("name"))
    other = (F.col("callee_file") != F.col("file_path")) | (F.col("callee_path") != F.col("caller_path"))
    pick = lambda df: df.select("key", "dotted", F.col("file_path").alias("callee_file"), F.col("symbol_path").alias("callee_path"), F.col("start_line").alias("callee_line"))
    a = caller.join(pick(near).withColumn("same", F.lit(0)), "key").filter("callee_file = file_path")
    b = caller.join(pick(far).withColumn("same", F.lit(1)), "key")
    both = a.unionByName(b).withColumn("symbol_path", F.col("callee_path")).filter(fits & other)
    best = F.min(F.struct("same", "callee_file", "callee_line", "callee_path"))
    own = ["site_id", F.col("file_path"), "line", "caller_path", "caller_line"]
    return both.groupBy(*own).agg(best.alias("b")).select(*own, "b.callee_file", "b.callee_path", "b.callee_line")


def emit(sites: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """The call edges of sites between symbols: edge_id, caller_id, callee_id, caller_file, callee_file, file_path, from_ranges and source."""
    at = symbols.select(F.col("file_path").alias("_f"), F.col("start_line").alias("_l"), "symbol_id")
    end = lambda which, file, line: at.select(F.col("_f").alias(file), F.col("_l").alias(line), F.col("symbol_id").alias(which))
    e = located(sites, chunks).withColumn("caller_file", F.col("file_path"))
    e = e.join(end("caller_id", "caller_file", "caller_line"), ["caller_file", "caller_line"]).join(end("callee_id", "callee_file", "callee_line"), ["callee_file", "callee_line"])
    ranges = F.concat(F.lit("[["), "line", F.lit(",0,"), "line", F.lit(",0]]"))
    return e.select(F.col("site_id").alias("edge_id"), "caller_id", "callee_id", "caller_file", "callee_file", "file_path", ranges.alias("from_ranges"), F.lit("treesitter").alias("source"))


def ensure_symbols(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_path, start_line, name, kind and whether the symbol is new: chunks without a symbol at their place get one."""
    c = chunks.groupBy("file_path", "start_line").agg(F.max_by(F.struct("symbol_path", "kind"), "chunk_id").alias("c"))
    s = symbols.groupBy("file_path", "start_line").agg(F.max_by(F.struct("name", "kind"), "symbol_id").alias("s"))
    both = s.join(c, ["file_path", "start_line"], "full")
    return both.select("file_path", "start_line", F.coalesce("s.name", leaf(F.col("c.symbol_path"))).alias("name"), F.coalesce("s.kind", "c.kind").alias("kind"), F.col("s").isNull().alias("fresh"))


def outgoing(calls: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Reported calls (caller_id, callee_file, callee_line) of functions, methods and constructors to symbols of indexed files."""
    able = symbols.filter(F.col("kind").isin("function", "method", "constructor")).select(F.col("symbol_id").alias("caller_id"))
    target = symbols.select(F.col("symbol_id").alias("callee_id"), F.col("file_path").alias("callee_file"), F.col("start_line").alias("callee_line"))
    hit = calls.join(able, "caller_id", "left_semi").join(target, ["callee_file", "callee_line"])
    return hit.join(files.select(F.col("file_path").alias("callee_file")), "callee_file", "left_semi").select("caller_id", "callee_id")


def with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes (file, node_id, kind, depth) with parent_id: the last node of one depth less before it.

    Every node is emitted as a parent on its level and as a child on the level
    above, so one window finds all parents.
    """
    up = nodes.withColumn("level", F.col("depth")).withColumn("as_parent", F.col("node_id"))
    down = nodes.withColumn("level", F.col("depth") - 1).withColumn("as_parent", F.lit(None).cast("int"))
    w = Window.partitionBy("file", "level").orderBy("node_id")
    both = up.unionByName(down).withColumn("parent_id", F.last("as_parent", True).over(w))
    return both.filter("as_parent IS NULL").select("file", "node_id", "kind", "depth", "parent_id")


def compile_query(text: str) -> list[tuple[str, str | None, int, str | None]]:
    """(kind, capture, number of the node above or -1, text predicate) of the nodes, in order, of a query such as `(ul (li) @a (li (a) @b))`.

    `_` is any kind; nodes inside one node are siblings in this order.  `(#eq? @a "text")`
    and `(#match? @a "regex")` after a node ask for the text of a capture; the predicate
    is an SQL condition on the column `text`.
    """
    parts = re.findall(r'"(?:\\.|[^"\\])*"|#[\w\-]+\?|[()]|@[\w.]+|[\w\-]+|\S', text)
    nodes: list[list] = []
    stack: list[int] = []
    at, last = 0, None
    while at < len(parts):
        p = parts[at]
        if p == "(" and parts[at + 1 : at + 2] and parts[at + 1] in ("#eq?", "#match?"):
            rest = parts[at + 1 : at + 5]
            if len(rest) < 4 or rest[3] != ")" or not rest[1].startswith("@") or not rest[2].startswith('"'):
                raise QueryError(text)
            hit = [n for n in nodes if n[1] == rest[1][1:]]
            if not hit:
                raise QueryError("no capture " + rest[1])
            value = re.sub(r"\\(.)", r"\1", rest[2][1:-1]) if rest[0] == "#eq?" else rest[2][1:-1]
            for n in hit:
                n[3] = [*(n[3] or []), (rest[0], value)]
            at += 5
        elif p == "(":
            if at + 1 >= len(parts) or not re.fullmatch(r"[\w\-]+", parts[at + 1]) or (nodes and not stack):
                raise QueryError(text)
            nodes.append([parts[at + 1], None, stack[-1] if stack else -1, None])
            stack.append(len(nodes) - 1)
            last = None
            at += 2
        elif p == ")" and stack:
            last = stack.pop()
            at += 1
        elif p.startswith("@") and last is not None:
            nodes[last][1] = p[1:]
            at += 1
        else:
            raise QueryError(text)
    if stack or not nodes:
        raise QueryError(text)
    return [tuple(n) for n in nodes]


def query_matches(nodes: DataFrame, query: str) -> DataFrame:
    """One row for each match: file, and the node (node_id, kind) of every pattern node as n0, n1, ...  `nodes` has parents."""
    df = None
    pattern = compile_query(query)
    for k, (kind, _, above, asked) in enumerate(pattern):
        level = nodes if kind == "_" else nodes.filter(F.col("kind") == kind)
        for how, value in asked or []:
            level = level.filter(F.col("text") == value if how == "#eq?" else F.col("text").rlike(value))
        level = level.select(F.col("file").alias("_f"), F.struct("node_id", "kind").alias(f"n{k}"), F.col("parent_id").alias("_p"))
        if df is None:
            df = level.withColumnRenamed("_f", "file").drop("_p")
            continue
        here = (F.col("file") == F.col("_f")) & (F.col("_p") == F.col(f"n{above}.node_id"))
        elder = max((j for j in range(k) if pattern[j][2] == above), default=None)
        if elder is not None:
            here &= F.col(f"n{k}.node_id") > F.col(f"n{elder}.node_id")
        df = df.join(level, here).drop("_f", "_p")
    return df


def query_nodes(nodes: DataFrame, query: str, limit: int | None = 50) -> DataFrame:
    """file, node_id, kind and capture of the captured nodes, in order of file and node."""
    pattern = compile_query(query)
    named = [F.struct(f"n{k}.node_id", f"n{k}.kind", F.lit(c).alias("capture")) for k, (_, c, *_) in enumerate(pattern) if c]
    named = named or [F.struct(f"n{len(pattern) - 1}.node_id", f"n{len(pattern) - 1}.kind", F.lit("").alias("capture"))]
    out = query_matches(nodes, query).select("file", F.explode(F.array(*named)).alias("c")).select("file", "c.*").distinct()
    return out if limit is None else out.orderBy("file", "node_id", "capture").limit(limit)


def query_progress(nodes: DataFrame, files: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """One row: files_scanned and truncated.  Files (column file) are scanned in order until `limit` matches are met."""
    n = query_matches(nodes, query).groupBy("file").agg(F.count("*").alias("n"))
    best = with_rank(files.select("file").distinct().join(n, "file", "left").withColumn("n", F.coalesce("n", F.lit(0))), "place", F.col("file"))
    # the last file is the first one with which the matches reach the limit: among the first `limit` files that have any
    some = best.filter("n > 0").orderBy("place").limit(limit)
    met = some.withColumn("sum", F.sum("n").over(Window.orderBy("place")))
    end = met.agg(F.min(F.when(F.col("sum") >= limit, F.col("place"))).alias("end"))
    return best.agg(F.count("*").alias("all")).crossJoin(F.broadcast(end)).select(F.coalesce("end", "all").alias("files_scanned"), F.col("end").isNotNull().alias("truncated"))


def flatten(nodes: DataFrame) -> DataFrame:
    """file, node_id and path: every node's kind after those of the nodes above, joined by dots.

    One level at a time, each written before the next; ends at the first empty level.
    `nodes` has parents, which precede their children, so there is an empty level.
    The levels lie in one folder and are read at once: the plan doesn't grow with the depth.
    """
    n = shared(nodes.select("file", "node_id", "kind", "parent_id"), "nodes")
    spark, folder, depth = nodes.sparkSession, shared_path(nodes.sparkSession, "levels"), 0
    level = n.filter("parent_id IS NULL").select("file", "node_id", F.col("kind").alias("path"))
    while True:
        level.write.parquet(f"{folder}/level={depth}")
        level = spark.read.schema(level.schema).parquet(f"{folder}/level={depth}")
        if level.isEmpty():
            break
        up = level.select("file", F.col("node_id").alias("parent_id"), F.col("path").alias("above"))
        level = n.join(up, ["file", "parent_id"]).select("file", "node_id", F.concat_ws(".", "above", "kind").alias("path"))
        depth += 1
    forget(n)
    return spark.read.schema(level.schema).parquet(folder).select("file", "node_id", "path")
