"""One question to every open root: answers interleaved by rank, failures listed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import shared
from .diagnostics import interleave


def fan_out(spark: SparkSession, contexts: dict[str, Callable[[], DataFrame]], limit: int) -> tuple[DataFrame | None, DataFrame]:
    """(the roots' rows with root, rank and position, the failures: root and message).

    Each context gives its rows with `rank` (from 1).  They run one after the other,
    each written to the shared folder, so an error in planning or running one root
    fails that root only.  Without any answer the first is None.
    """
    answers, failures = [], []
    for root in sorted(contexts):
        try:
            answers.append(shared(contexts[root]().filter(F.col("rank") <= limit).withColumn("root", F.lit(root)), "answer"))
        except Exception as e:  # whatever a root's question fails with is an answer too
            failures.append((root, f"{type(e).__name__}: {e}".split("\n")[0]))
    both = None
    for a in answers:
        both = a if both is None else both.unionByName(a)
    return None if both is None else interleave(both, limit), spark.createDataFrame(failures, "root string, message string")
