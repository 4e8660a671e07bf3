"""Bounded traversal of the call graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import forget, shared
from .symbols import get_symbol

SOURCES = ("lsp", "treesitter")


class NotFound(LookupError):
    """The root isn't a symbol."""


def checked_edges(edges: DataFrame) -> DataFrame:
    """`edges`, failing on a source that isn't known."""
    bad = F.raise_error(F.concat(F.lit("unknown edge source "), F.coalesce("source", F.lit("null")))).cast("string")
    return edges.withColumn("source", F.when(F.col("source").isin(*SOURCES), F.col("source")).otherwise(bad))


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """from_id, to_id of one step in a direction."""
    out = edges.select(F.col("caller_id").alias("from_id"), F.col("callee_id").alias("to_id"))
    back = edges.select(F.col("callee_id").alias("from_id"), F.col("caller_id").alias("to_id"))
    return {"outbound": out, "inbound": back}.get(direction) if direction != "both" else out.unionByName(back)


def levels(roots: DataFrame, edges: DataFrame, direction: str, depth: int) -> DataFrame:
    """node_id and depth: everything within `depth` steps of the roots (column node_id), at its least depth.

    Level k holds the nodes that no earlier level has.  Each level is written
    before the next begins, so plans don't grow with depth; the traversal ends
    at the first empty level.
    """
    step = shared(steps(edges, direction).filter("from_id <> to_id").distinct(), "steps")
    seen = shared(roots.select(F.col("node_id"), F.lit(0).alias("depth")).distinct(), "level")
    frontier = seen
    for k in range(1, depth + 1):
        reach = step.join(frontier.select(F.col("node_id").alias("from_id")), "from_id").select(F.col("to_id").alias("node_id")).distinct()
        frontier = shared(reach.join(seen.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(k)), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    forget(step)
    return seen


def call_graph(roots: DataFrame, edges: DataFrame, direction: str = "outbound", max_depth: int = 2) -> DataFrame:
    """The recorded edges: edge_id, caller_id, callee_id, source, depth, and the node that was expanded.

    Each node nearer than the depth (1 to 5) is expanded once.  With `both` an
    edge is listed for each end that is expanded.
    """
    depth = min(5, max(1, max_depth))
    near = shared(levels(roots, edges, direction, depth - 1).select(F.col("node_id").alias("expanded"), (F.col("depth") + 1).alias("depth")), "expanded")
    e = checked_edges(edges).select("edge_id", "caller_id", "callee_id", "source")
    parts = []
    if direction in ("outbound", "both"):
        parts.append(e.join(near, e["caller_id"] == near["expanded"]).withColumn("way", F.lit("outbound")))
    if direction in ("inbound", "both"):
        parts.append(e.join(near, e["callee_id"] == near["expanded"]).withColumn("way", F.lit("inbound")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def with_names(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """`call_graph`'s edges with the names and files of both ends; edges without a symbol at an end go."""
    for end in ("caller", "callee"):
        found = found.join(symbols.select(F.col("symbol_id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"), F.col("file_path").alias(f"{end}_file")), f"{end}_id")
    return found


def root_of(identifier: str, candidates: DataFrame, symbols: DataFrame) -> DataFrame:
    """node_id of a `file:line:column` or, where no symbol lies there, of the best match of a name among `candidates` (merged symbols); fails where there is neither."""
    m = re.fullmatch(r"(.+):(\d+):(\d+)", identifier)
    if m:
        at = locate(symbols, m[1], int(m[2]), int(m[3]))
        if not at.isEmpty():
            return at
    best = get_symbol(candidates, identifier, limit=1).select("file_path", "start_line")
    at = symbols.join(F.broadcast(best), ["file_path", "start_line"]).orderBy("symbol_id").limit(1).select(F.col("symbol_id").alias("node_id"))
    if at.isEmpty():
        raise NotFound(identifier)
    return at


def locate(symbols: DataFrame, file: str, line: int, column: int) -> DataFrame:
    """node_id of the narrowest symbol at a position; the start column counts on every line, the end column on none."""
    hit = symbols.filter((F.col("file_path") == file) & (F.col("start_line") <= line) & (F.col("end_line") >= line) & (F.col("start_column") <= column))
    return hit.orderBy(F.col("end_line") - F.col("start_line"), "symbol_id").limit(1).select(F.col("symbol_id").alias("node_id"))


def blast_radius(symbols: DataFrame, edges: DataFrame, file: str, symbol: str | None = None, max_hops: int = 3) -> DataFrame:
    """hop, symbol_id, name, file_path and source of everything that reaches the file's symbols.

    `source` is that of the edge of least id from the hop before.
    """
    hops = min(10, max(1, max_hops))
    roots = symbols.filter(F.col("file_path") == file)
    if symbol is not None:
        roots = roots.filter(F.col("name") == symbol)
        if roots.isEmpty():
            raise NotFound(symbol)
    at = shared(levels(roots.select(F.col("symbol_id").alias("node_id")), edges, "inbound", hops), "hops")
    x, y = at.alias("x"), at.alias("y")
    found = edges.join(x, F.col("caller_id") == F.col("x.node_id")).join(y, (F.col("callee_id") == F.col("y.node_id")) & (F.col("x.depth") == F.col("y.depth") + 1))
    first = found.groupBy(F.col("x.node_id").alias("symbol_id"), F.col("x.depth").alias("hop")).agg(F.min_by("source", "edge_id").alias("source"))
    return first.join(symbols.select("symbol_id", "name", "file_path"), "symbol_id").select("hop", "symbol_id", "name", "file_path", "source")


def blast_totals(found: DataFrame) -> DataFrame:
    """Symbols and distinct files of each hop, and overall as hop 0."""
    return found.groupBy("hop").agg(F.count("*").alias("symbols"), F.countDistinct("file_path").alias("files")).unionByName(found.agg(F.lit(0).alias("hop"), F.count("*").alias("symbols"), F.countDistinct("file_path").alias("files")))


