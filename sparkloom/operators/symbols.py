"""Symbols: the merge of parsed chunks with reported symbols, and look-up by tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import leaf, with_fuzzy

META = {"function": "function", "method": "method", "constructor": "method", "class": "type", "struct": "type", "interface": "type", "enum": "type", "type": "type", "trait": "type", "protocol": "type", "typealias": "type"}
TIERS = ("exact", "suffix", "caseInsensitive", "fuzzy")


def meta_type(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in META.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(kind)), F.lit("other"))


def _last(df: DataFrame, key: str) -> DataFrame:
    """One row for each file and start line: the last writer's."""
    w = Window.partitionBy("file_path", "start_line").orderBy(F.desc(key))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """The full outer join on file and start line.

    Of a pair, the symbol gives name, columns, kind and detail; the chunk keeps text,
    qualified path and lines.
    """
    c, s = _last(chunks, "chunk_id").alias("c"), _last(symbols, "symbol_id").alias("s")
    both = c.join(s, (F.col("c.file_path") == F.col("s.file_path")) & (F.col("c.start_line") == F.col("s.start_line")), "full")
    has_c, has_s = F.col("c.chunk_id").isNotNull(), F.col("s.symbol_id").isNotNull()
    return both.select(
        F.coalesce("c.file_path", "s.file_path").alias("file_path"),
        F.coalesce("c.start_line", "s.start_line").alias("start_line"),
        F.coalesce("c.end_line", "s.end_line").alias("end_line"),
        F.coalesce("s.start_column", F.lit(0)).alias("start_column"),
        F.coalesce(F.col("s.name"), leaf(F.col("c.symbol_path"))).alias("name"),
        F.coalesce("c.symbol_path", "s.name").alias("qualified_path"),
        meta_type(F.coalesce("s.kind", "c.kind")).alias("meta"),
        F.col("s.detail").alias("detail"),
        F.col("c.text").alias("text"),
        F.when(has_c & has_s, "merged").when(has_c, "treesitter").otherwise("lsp").alias("source"),
    )


def get_symbol(candidates: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The matches of the first tier that has any, with `tier` and `score`.

    Tiers are found in one pass; the best is a one-row aggregate that is joined back.
    """
    path, q = F.col("qualified_path"), F.lit(query)
    bonus = F.greatest(F.lit(0), F.lit(100) - F.length(path))
    df = with_fuzzy(candidates, path, query, "_fuzzy")
    tier = F.when(path == q, 0).when(F.endswith(path, F.lit("." + query)), 1).when(F.contains(F.lower(path), F.lower(q)), 2).when(F.col("_fuzzy").isNotNull(), 3)
    df = df.withColumn("_tier", tier).filter("_tier IS NOT NULL")
    best = df.agg(F.min("_tier").alias("_best"))
    score = F.when(F.col("_tier") == 0, F.lit(1000)).when(F.col("_tier") == 1, F.lit(900) + bonus).when(F.col("_tier") == 2, F.lit(800) + bonus).otherwise(F.col("_fuzzy"))
    df = df.join(F.broadcast(best), F.col("_tier") == F.col("_best")).withColumn("score", score.cast("int")).withColumn("tier", F.element_at(F.array(*map(F.lit, TIERS)), F.col("_tier") + 1))
    return df.drop("_tier", "_best", "_fuzzy").orderBy(F.desc("score"), "file_path", "start_line").limit(limit)


def search_symbol(candidates: DataFrame, query: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Fuzzy matches of the qualified path, else of the name."""
    df = candidates if kind is None else candidates.filter(F.col("meta") == kind)
    df = with_fuzzy(with_fuzzy(df, F.col("qualified_path"), query, "_path"), F.col("name"), query, "_name")
    df = df.withColumn("score", F.coalesce("_path", "_name")).filter("score IS NOT NULL").drop("_path", "_name")
    return df.orderBy(F.desc("score"), "file_path", "start_line").limit(limit)


def list_symbols(candidates: DataFrame, file: str) -> DataFrame:
    return candidates.filter(F.col("file_path") == file).orderBy("start_line")
