"""Little-endian Float32 blobs, for import and export of embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


@F.arrow_udf(BinaryType())
def to_blob(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for v in batches:
        yield pa.array([None if x is None else np.asarray(x, "<f4").tobytes() for x in v.to_pylist()], pa.binary())


@F.arrow_udf(ArrayType(FloatType()))
def from_blob(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Null where the length isn't a multiple of 4."""
    for v in batches:
        yield pa.array([None if x is None or len(x) % 4 else np.frombuffer(x, "<f4").tolist() for x in v.to_pylist()], pa.list_(pa.float32()))
