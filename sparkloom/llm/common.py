"""Column picking and shared-folder tables for the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def take(df: DataFrame, *names: str) -> DataFrame:
    """The columns of these exact names, whatever else the table holds.

    Columns are found by position, so further columns whose names differ only
    in case, or equal a name used inside an operator, do no harm.
    """
    have = df.columns
    for n in names:
        if n not in have:
            raise ValueError(f"no column {n!r} among {have}")
    flat = df.toDF(*[f"c{i}" for i in range(len(have))])
    return flat.select(*[F.col(f"c{have.index(n)}").alias(n) for n in names])


_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def whole_ids(df: DataFrame, name: str) -> DataFrame:
    """The table with this column as long; a column of another type than whole numbers is refused."""
    kind = dict(df.dtypes)[name]
    if kind not in _WHOLE and kind != "void":
        raise ValueError(f"ids must be whole numbers, not {kind}")
    return df.withColumn(name, F.col(name).cast("long"))


def flat(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table with its columns named `c0`, `c1`, ... and the names that they had."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset and the master is local."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again.

    This cuts the lineage in a way that outlives executors, and the optimiser
    then knows the true size.  `forget` or the end of the driver removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._sparkloom_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_sparkloom_path", None)
        if path:
            _delete(df.sparkSession, path)
            _made[:] = [x for x in _made if x[1] != path]


@atexit.register
def _forget_all() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM has ended before; its folder goes with the cluster's
            return


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, *, id_col: str = "doc_id", text_col: str = "text"):
    """Up to `bound` labelled documents for fitting, as pandas with id, text and label 0 or 1.

    The labels are taken in the order of a hash of the id, so the sample is
    spread over the table and the same in every run.  Rows with a null id,
    label or text don't count; of repeated ids one row does.
    """
    y = whole_ids(take(labels, id_col, label).toDF("id", "y"), "id").filter("id IS NOT NULL AND y IN (0, 1)")
    y = y.groupBy("id").agg(F.max("y").cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(bound)
    d = whole_ids(take(docs, id_col, text_col).toDF("id", "text"), "id").filter("text IS NOT NULL")
    return d.join(F.broadcast(y), "id").groupBy("id", "y").agg(F.min("text").alias("text")).toPandas().sort_values("id").reset_index(drop=True)
