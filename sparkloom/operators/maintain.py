"""Incremental maintenance of the index: differences, dirty flags, cascades, invalidation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import with_rank

FLAGS = {"treesitter": "ts_indexed", "lsp": "lsp_indexed", "embedding": "embedded"}


def reconcile(disk: DataFrame, index: DataFrame) -> DataFrame:
    """file_path and status: added, changed, removed or unchanged."""
    d, i = disk.alias("d"), index.alias("i")
    status = F.when(F.col("i.content_hash").isNull(), "added").when(F.col("d.content_hash").isNull(), "removed").when(F.col("d.content_hash") != F.col("i.content_hash"), "changed").otherwise("unchanged")
    return d.join(i, F.col("d.file_path") == F.col("i.file_path"), "full").select(F.coalesce("d.file_path", "i.file_path").alias("file_path"), status.alias("status"))


def reconcile_stats(diff: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return diff.agg(F.count_if(F.col("status") != "removed").alias("walked"), count("added").alias("added"), count("changed").alias("changed"), count("removed").alias("removed"))


def mark_dirty(index: DataFrame, files: DataFrame) -> DataFrame:
    """The index after inserting or updating `files` (file_path, content_hash, file_size) with all flags cleared."""
    i, f = index.alias("i"), files.alias("f")
    new = F.col("f.file_path").isNotNull()
    flags = [F.when(new, F.lit(False)).otherwise(F.col(f"i.{c}")).alias(c) for c in FLAGS.values()]
    return i.join(f, F.col("i.file_path") == F.col("f.file_path"), "full").select(F.coalesce("f.file_path", "i.file_path").alias("file_path"), F.coalesce("f.content_hash", "i.content_hash").alias("content_hash"), F.coalesce("f.file_size", "i.file_size").alias("file_size"), *flags)


def dirty(index: DataFrame, layer: str) -> DataFrame:
    """The files that a layer hasn't done, by path."""
    return index.filter(~F.col(FLAGS[layer])).select("file_path").orderBy("file_path")


def mark_indexed(index: DataFrame, files: DataFrame, layer: str) -> DataFrame:
    done = index.join(files.select("file_path").distinct().withColumn("_d", F.lit(True)), "file_path", "left")
    return done.withColumn(FLAGS[layer], F.col(FLAGS[layer]) | F.coalesce("_d", F.lit(False))).drop("_d")


def rebuild(index: DataFrame, layer: str) -> DataFrame:
    """The index with the flag of a layer, or all three, cleared."""
    flags = FLAGS.values() if layer == "all" else [FLAGS[layer]]
    return index.withColumns({f: F.lit(False) for f in flags})


def status(index: DataFrame, chunks: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of all tables, and the percentage of files each layer has done (0 without files)."""
    n = F.count("*")
    percent = [F.when(n == 0, 0.0).otherwise(100.0 * F.count_if(f) / n).alias(f"{f}_percent") for f in FLAGS.values()]
    one = index.agg(n.alias("files"), *percent)
    for name, df in (("chunks", chunks), ("symbols", symbols), ("edges", edges)):
        one = one.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))
    return one


def cascade_delete(files: DataFrame, chunks: DataFrame, symbols: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Chunks, symbols and edges without those of the deleted files; edges also go with either end."""
    gone = files.select("file_path").distinct()
    dead = symbols.join(gone, "file_path", "left_semi").select("symbol_id").distinct()
    e = edges.join(gone, "file_path", "left_anti")
    for end in ("caller_id", "callee_id"):
        e = e.join(dead.withColumnRenamed("symbol_id", end), end, "left_anti")
    return {"chunks": chunks.join(gone, "file_path", "left_anti"), "symbols": symbols.join(gone, "file_path", "left_anti"), "edges": e}


def vanished(old: DataFrame, new: DataFrame) -> DataFrame:
    """Symbols of `old` in files that `new` covers, whose start line is gone."""
    covered = new.select("file_path").distinct()
    return old.join(covered, "file_path", "left_semi").join(new.select("file_path", "start_line").distinct(), ["file_path", "start_line"], "left_anti")


def invalidated(deleted: DataFrame, edges: DataFrame) -> DataFrame:
    """Files with an edge into or out of a deleted symbol, other than that symbol's own."""
    d = deleted.select("symbol_id", F.col("file_path").alias("own"))
    hits = [edges.join(d, F.col(end) == F.col("symbol_id")).filter("file_path <> own").select("file_path") for end in ("caller_id", "callee_id")]
    return hits[0].unionByName(hits[1]).distinct()


def replace_chunks(chunks: DataFrame, files: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks with those of `files` replaced by `fresh`; a file that gives none loses its old ones."""
    return chunks.join(files.select("file_path").distinct(), "file_path", "left_anti").unionByName(fresh)


def parsed(index: DataFrame, files: DataFrame) -> DataFrame:
    """The index after `files` were parsed: that layer is done, and their embeddings are due."""
    done = index.join(files.select("file_path").distinct().withColumn("_d", F.lit(True)), "file_path", "left")
    is_ = F.coalesce("_d", F.lit(False))
    return done.withColumns({"ts_indexed": F.col("ts_indexed") | is_, "embedded": F.col("embedded") & ~is_}).drop("_d")


def replace_edges(edges: DataFrame, files: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges with the parsed ones of `files` replaced; reported ones stay."""
    old = (F.col("source") == "treesitter") & F.col("_f").isNotNull()
    kept = edges.join(files.select("file_path").distinct().withColumn("_f", F.lit(1)), "file_path", "left").filter(~old).drop("_f")
    return kept.unionByName(fresh)


def drain_embeddings(chunks: DataFrame, fresh: DataFrame, dims: int) -> DataFrame:
    """Chunks with new embeddings (chunk_id, embedding).  Where the stored ones have another dimension all of them are dropped first; new ones of a wrong dimension don't count."""
    have = chunks.agg(F.count_if(F.col("embedding").isNotNull() & (F.size("embedding") != dims)).alias("_bad"))
    f = fresh.filter(F.size("embedding") == dims).select("chunk_id", F.col("embedding").alias("_new"))
    both = chunks.crossJoin(F.broadcast(have)).join(f, "chunk_id", "left")
    return both.withColumn("embedding", F.coalesce(F.col("_new"), F.when(F.col("_bad") == 0, F.col("embedding")))).drop("_new", "_bad")


def mark_uncovered(index: DataFrame, extensions: list[str]) -> DataFrame:
    """Files whose extension no running server covers count as done for that layer."""
    ext = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    return index.withColumn("lsp_indexed", F.col("lsp_indexed") | ~ext.isin([x.lower() for x in extensions]))


def signatures(chunks: DataFrame) -> DataFrame:
    """file_path and the ordered list of (chunk id, embedding bytes) as text."""
    one = F.concat(F.col("chunk_id"), F.lit(":"), F.coalesce(4 * F.size("embedding"), F.lit(0)))
    return chunks.groupBy("file_path").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", one.alias("s")))), lambda x: x["s"])).alias("signature"))


def signature_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path and status of the files whose postings must be made again or dropped."""
    o, n = old.alias("o"), new.alias("n")
    status = F.when(F.col("o.signature").isNull(), "added").when(F.col("n.signature").isNull(), "removed").when(F.col("o.signature") != F.col("n.signature"), "changed")
    return o.join(n, F.col("o.file_path") == F.col("n.file_path"), "full").select(F.coalesce("o.file_path", "n.file_path").alias("file_path"), status.alias("status")).filter("status IS NOT NULL")


def batches(index: DataFrame, layer: str, size: int = 50) -> DataFrame:
    """file_path and batch (from 0) of the files that a layer hasn't done: `size` at a time, by path."""
    due = with_rank(index.filter(~F.col(FLAGS[layer])).select("file_path"), "place", F.col("file_path"))
    return due.select("file_path", F.floor((F.col("place") - 1) / size).alias("batch"))


def settle_outcomes(index: DataFrame, outcomes: DataFrame, layer: str) -> DataFrame:
    """The index after a batch: files that were done, unsafe or unreadable (outcome) count as done; those that failed at the server stay due, and no failure stops the others."""
    done = outcomes.filter(F.col("outcome").isin("done", "unsafe", "unreadable"))
    return mark_indexed(index, done, layer)


def re_extract(symbols: DataFrame, fresh: DataFrame, edges: DataFrame, fresh_edges: DataFrame, index: DataFrame) -> dict[str, DataFrame]:
    """symbols, edges and files after files were extracted anew.

    Symbols of the files in `fresh` whose start line is gone are deleted, edges with such
    an end go with them, and the other files of those edges are due again; symbols at the
    same place keep their id and take the new name and kind; reported edges of the extracted
    files are replaced.
    """
    gone = vanished(symbols, fresh)
    due = invalidated(gone, edges).join(fresh.select("file_path").distinct(), "file_path", "left_anti")
    dead = gone.select("symbol_id")
    covered = fresh.select("file_path").distinct()
    old = symbols.join(covered, "file_path", "left_semi").select("file_path", "start_line", F.col("symbol_id").alias("_id"))
    new = fresh.join(old, ["file_path", "start_line"], "left").withColumn("symbol_id", F.coalesce("_id", "symbol_id")).drop("_id")
    kept = edges.join(dead.withColumnRenamed("symbol_id", "caller_id"), "caller_id", "left_anti").join(dead.withColumnRenamed("symbol_id", "callee_id"), "callee_id", "left_anti")
    kept = kept.join(covered.withColumn("_c", F.lit(1)), "file_path", "left").filter("_c IS NULL OR source <> 'lsp'").drop("_c")
    flags = index.join(due.withColumn("_due", F.lit(True)), "file_path", "left")
    flags = flags.withColumn("lsp_indexed", F.col("lsp_indexed") & F.col("_due").isNull()).drop("_due")
    return {"symbols": symbols.join(covered, "file_path", "left_anti").unionByName(new), "edges": kept.unionByName(fresh_edges), "files": mark_indexed(flags, covered, "lsp")}


def readiness(progress: DataFrame, servers: DataFrame) -> DataFrame:
    """One row: drained and ready.  A server is settled when running, not found, or failed at least 5 times."""
    drained = progress.agg(F.coalesce(F.bool_and((F.col("parsed") >= F.col("walked")) & (F.col("embedded") >= F.col("walked")) & (F.col("lsp_indexed") >= F.col("walked"))), F.lit(True)).alias("drained"))
    settled = servers.agg(F.coalesce(F.bool_and(F.col("state").isin("running", "notFound") | ((F.col("state") == "failed") & (F.col("attempts") >= 5))), F.lit(True)).alias("settled"))
    return drained.crossJoin(settled).select("drained", (F.col("drained") & F.col("settled")).alias("ready"))


def manager_ready(contexts: DataFrame) -> DataFrame:
    """Whether every context is ready; true without any."""
    return contexts.agg(F.coalesce(F.bool_and("ready"), F.lit(True)).alias("ready"))
