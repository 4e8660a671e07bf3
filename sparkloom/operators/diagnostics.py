"""Diagnostics reports over targets and the files that depend on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dependents(symbols: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Files one call away from a target, other than targets, by path.  `targets` has file_path."""
    t = targets.select("file_path").distinct()
    callee = symbols.join(t, "file_path", "left_semi").select(F.col("symbol_id").alias("callee_id"))
    caller = edges.join(callee, "callee_id", "left_semi").select(F.col("caller_id").alias("symbol_id")).distinct()
    return symbols.join(caller, "symbol_id", "left_semi").select("file_path").distinct().join(t, "file_path", "left_anti").orderBy("file_path")


def report(diagnostics: DataFrame, targets: DataFrame, depending: DataFrame, severity: int = 2, cap: int = 100) -> DataFrame:
    """uri, diag_id, severity and position of the report's records.

    Targets come first, in their order (`ord`), then dependents with an error or warning
    by errors, warnings and path; what lies beyond the cap is dropped.
    """
    floor = diagnostics.filter(F.col("severity") <= severity)
    t = targets.select(F.col("file_path").alias("uri"), "ord", F.lit(0).alias("tier"))
    d = depending.select(F.col("file_path").alias("uri"), F.lit(0).alias("ord"), F.lit(1).alias("tier"))
    counts = floor.groupBy("uri").agg(F.count_if(F.col("severity") == 1).alias("errors"), F.count_if(F.col("severity") == 2).alias("warnings"))
    files = t.unionByName(d).join(counts, "uri").filter("tier = 0 OR errors > 0 OR warnings > 0")
    rows = floor.join(files, "uri")
    order = [F.col("tier"), F.when(F.col("tier") == 0, F.col("ord")).otherwise(0), F.when(F.col("tier") == 1, -F.col("errors")).otherwise(0), F.when(F.col("tier") == 1, -F.col("warnings")).otherwise(0), F.col("uri"), F.col("diag_id")]
    best = rows.orderBy(*order).limit(cap)
    return best.withColumn("position", F.row_number().over(Window.orderBy(*order))).select("position", "uri", "diag_id", "severity", "message")


def totals(records: DataFrame) -> DataFrame:
    """errors, warnings and records; made of a report, so after its cap."""
    return records.agg(F.count_if(F.col("severity") == 1).alias("errors"), F.count_if(F.col("severity") == 2).alias("warnings"), F.count("*").alias("records"))


def interleave(hits: DataFrame, limit: int) -> DataFrame:
    """Rank-major merge of roots' results (root, rank): all first hits by root, then all second ones; scores of roots never compare."""
    best = hits.orderBy("rank", "root").limit(limit)
    return best.withColumn("position", F.row_number().over(Window.orderBy("rank", "root")))
