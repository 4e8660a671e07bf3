"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .block_ann import SQL2, op2
from .bpe import op8
from .language_crf import op6
from .near_dedup import op10
from .packing import op9
from .pii import op4
from .quality_knn import op7
from .quality_rules import SQL3, op3
from .secret_scan import op1
from .toxicity_knn import op5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1,
    "op2_block_ann": op2,
    "op3_quality_rules": op3,
    "op4_pii": op4,
    "op5_toxicity_knn": op5,
    "op6_language_crf": op6,
    "op7_quality_knn": op7,
    "op8_bpe": op8,
    "op9_best_fit_packing": op9,
    "op10_near_dedup": op10,
}

SQL: dict[str, str] = {
    "op2_block_ann": SQL2,
    "op3_quality_rules": SQL3,
}
