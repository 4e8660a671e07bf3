"""A global row number that isn't computed in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import shared


def with_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds the 1-based position in the order, which must be total.

    Rows are range-partitioned and written once to the shared folder; the
    partitions' sizes give offsets, and ranks are counted inside partitions.
    """
    part = shared(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranked")
    sizes = part.groupBy("_p").count()
    before = sizes.select("_p", (F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return part.join(F.broadcast(before), "_p").withColumn(name, (inside + F.col("_before")).cast("long")).drop("_p", "_before")
