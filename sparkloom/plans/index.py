"""The index of a directory: files, chunks, symbols, call sites and edges as Parquet tables.

`build` reads the whole tree; `update` parses only what changed, resolves only the
call sites that this can touch, and gives the tables that a new `build` would.  Every
change is a new version beside the last, which stays readable until the new one is
whole; a marker file, written last, makes a version count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import leaf
from ..operators import edges, maintain
from ..sources import chunker, tree
from .session import forget, shared

TABLES = ("files", "chunks", "symbols", "sites", "edges")
Embed = Callable[[list[str]], list[list[float]]]


def embed(texts: Column, embedder: Embed, dims: int, at_once: int = 64) -> Column:
    """The embeddings of texts by a function of lists; null where it fails, or gives another number or dimension.

    A batch that fails is tried text by text, so one bad text doesn't cost the others.
    """

    def some(batch: list[str]) -> list:
        try:
            got = [list(map(float, v)) for v in embedder(batch)]
        except Exception:  # whatever the function fails with, its texts stay due
            got = None
        if got is not None and len(got) == len(batch):
            return [v if len(v) == dims else None for v in got]
        return [None] if len(batch) == 1 else [v for t in batch for v in some([t])]

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        have = column.to_pylist()
        out: list = [None] * len(have)
        real = [k for k, t in enumerate(have) if t is not None]
        for k in range(0, len(real), at_once):
            part = real[k : k + at_once]
            for i, v in zip(part, some([have[i] for i in part])):
                out[i] = v
        return pa.array(out, pa.list_(pa.float64()))

    return run(texts)


class Index:
    """Tables of one directory in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, modules: Sequence[chunker.Module] = (), embedder: Embed | None = None, dims: int = 0):
        self.spark, self.folder, self.modules, self.embedder, self.dims = spark, folder.rstrip("/"), modules, embedder, dims

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The whole versions, oldest first."""
        p, fs = self._fs(self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".done"))

    def table(self, name: str) -> DataFrame:
        have = self.versions()
        if not have:
            raise LookupError(f"no index in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/v{have[-1]}/{name}")

    def chunks(self) -> DataFrame:
        return self.table("chunks")

    def embedded(self) -> DataFrame:
        return self.table("chunks").filter("embedding IS NOT NULL").select("chunk_id", "embedding")

    def symbols(self) -> DataFrame:
        return self.table("symbols")

    def edges(self) -> DataFrame:
        return self.table("edges")

    def _write(self, tables: dict[str, DataFrame]) -> None:
        have = self.versions()
        version = have[-1] + 1 if have else 1
        for name in TABLES:
            tables[name].write.mode("overwrite").parquet(f"{self.folder}/v{version}/{name}")
        p, fs = self._fs(f"{self.folder}/v{version}.done")
        fs.create(p).close()
        for old in have[:-1]:  # readers of the version before may still be at work
            for path in (f"{self.folder}/v{old}.done", f"{self.folder}/v{old}"):
                p, fs = self._fs(path)
                fs.delete(p, True)

    def _parsed(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(chunks with ids, call sites with ids) of files with their text."""
        c = chunker.chunks(files, self.modules).distinct()
        vector = embed(F.col("text"), self.embedder, self.dims) if self.embedder else F.lit(None).cast("array<double>")
        c = c.withColumn("chunk_id", F.xxhash64("file_path", "start_byte", "end_byte", "symbol_path", "kind")).withColumn("embedding", vector)
        s = chunker.calls(files, self.modules).groupBy("file_path", "line", "name").count().select("file_path", "line", "name", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("k"))
        return c, s.withColumn("site_id", F.xxhash64("file_path", "line", "name", "k")).drop("k")

    def _symbols(self, chunks: DataFrame) -> DataFrame:
        none = self.spark.createDataFrame([], "file_path string, start_line int, name string, kind string, symbol_id long")
        s = edges.ensure_symbols(none, chunks)
        end = chunks.groupBy("file_path", "start_line").agg(F.max_by("end_line", "chunk_id").alias("end_line"))
        s = s.join(end, ["file_path", "start_line"])
        return s.select(F.xxhash64("file_path", "start_line").alias("symbol_id"), "name", "kind", "file_path", "start_line", F.lit(0).alias("start_column"), "end_line", F.lit(0).alias("end_column"), F.lit(None).cast("string").alias("detail"))

    def _files(self, disk: DataFrame) -> DataFrame:
        """Parsed files; their embeddings are done where there is an embedder, and its failures stay null in the chunks."""
        return disk.select("file_path", "content_hash", "file_size", F.lit(True).alias("ts_indexed"), F.lit(False).alias("lsp_indexed"), F.lit(self.embedder is not None).alias("embedded"))

    def build(self, root: str, rules: DataFrame | None = None) -> None:
        """Indexes the whole tree."""
        disk = tree.walk(self.spark, root, rules)
        chunks, sites = (shared(x, "parsed") for x in self._parsed(disk))
        symbols = shared(self._symbols(chunks), "symbols")
        self._write({"files": self._files(disk), "chunks": chunks, "symbols": symbols, "sites": sites, "edges": edges.emit(sites, chunks, symbols)})
        forget(chunks, sites, symbols)

    def update(self, root: str, rules: DataFrame | None = None) -> DataFrame:
        """Takes over what changed since; returns the counts of `reconcile_stats`."""
        old = {name: self.table(name) for name in TABLES}
        disk = tree.walk(self.spark, root, rules)
        diff = shared(maintain.reconcile(disk.select("file_path", "content_hash"), old["files"]), "diff")
        stats = maintain.reconcile_stats(diff)
        if diff.filter("status <> 'unchanged'").isEmpty():
            return stats
        gone = diff.filter("status IN ('changed', 'removed')").select("file_path")
        due = diff.filter("status IN ('changed', 'added')").select("file_path")
        fresh, fresh_sites = (shared(x, "parsed") for x in self._parsed(disk.join(due, "file_path", "left_semi")))
        chunks = shared(maintain.replace_chunks(old["chunks"], gone, fresh), "chunks")
        sites = shared(maintain.replace_chunks(old["sites"], gone, fresh_sites), "sites")
        symbols = shared(old["symbols"].join(gone, "file_path", "left_anti").unionByName(self._symbols(fresh)), "symbols")
        # a site is resolved anew if its file is new or a chunk of its name came or went
        names = old["chunks"].join(gone, "file_path", "left_semi").select("symbol_path").unionByName(fresh.select("symbol_path")).select(F.lower(leaf(F.col("symbol_path"))).alias("key")).distinct()
        again = sites.join(due, "file_path", "left_semi").unionByName(sites.join(due, "file_path", "left_anti").withColumn("key", F.lower("name")).join(names, "key", "left_semi").drop("key"))
        again = shared(again, "again")
        kept = old["edges"].join(gone, "file_path", "left_anti").join(again.select(F.col("site_id").alias("edge_id")), "edge_id", "left_anti")
        files = old["files"].join(gone, "file_path", "left_anti").unionByName(self._files(disk.join(due, "file_path", "left_semi")))
        self._write({"files": files, "chunks": chunks, "symbols": symbols, "sites": sites, "edges": kept.unionByName(edges.emit(again, chunks, symbols))})
        forget(fresh, fresh_sites, chunks, sites, symbols, again)
        return stats
