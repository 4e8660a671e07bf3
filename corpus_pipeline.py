"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir); `run` writes what it returns as Parquet
to the shared folder and reads it again as the next stage's documents.

All stages but the last return the columns that they get, in their order; columns of any
further name go along, also where they clash with names that a stage uses.  Repeated rows
stay repeated rows, and a table without rows gives none.  Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import written
from sparkloom.llm.language_crf import drop_unidentified
from sparkloom.llm.near_dedup import drop_near_duplicates
from sparkloom.llm.packing import pack
from sparkloom.llm.quality_knn import drop_low_quality
from sparkloom.llm.secret_scan import mask_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours vote against them go.

    A null or empty text has no neighbours and stays; without labels all stay.  A score of
    exactly one half stays; of equally near neighbours the one of the lesser id votes.
    """
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words, or whose words fit no language, go.

    So null and empty texts go.  Without any document of a known `lang` all stay.  A
    certainty of exactly the threshold stays.
    """
    return drop_unidentified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays.

    Rows with a null id, and texts without a word, are in no group and stay.  Rows that
    repeat an id stay or go together.
    """
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars follows where a text changes.

    All rows stay, null and empty texts as they are.
    """
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences: a row for each piece.

    Null and empty texts have no piece; rows with a null id and repeated rows are packed
    like others, of equal lengths in the order of the table's rows.
    """
    return pack(docs)


STAGES = [("quality classifier", quality), ("language ID", language), ("MinHash near-dedup", near_dedup), ("secret scans", secrets), ("best-fit packing", packing)]

#: Models, hashing and packing can't be written as SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
