"""Regular-expression search over chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, glob_regex


class PatternError(ValueError):
    """The pattern doesn't compile."""


def _scope(chunks: DataFrame, languages: list[str] | None, glob: str | None) -> DataFrame:
    """The path filters; languages are compared with the file's extension."""
    df = chunks
    if languages:
        df = df.filter(extension(F.col("file_path")).isin([x.lower() for x in languages]))
    if glob:
        df = df.filter(F.col("file_path").rlike(glob_regex(glob)))
    return df


def _checked(pattern: str) -> str:
    try:
        re.compile(pattern)
    except re.error as e:
        raise PatternError(str(e)) from e
    return pattern


def grep(chunks: DataFrame, pattern: str, languages: list[str] | None = None, glob: str | None = None, limit: int | None = 50) -> DataFrame:
    """The matching chunks with `n_matches`, by file and line; filter and count run in the JVM."""
    df = _scope(chunks, languages, glob).filter(F.col("text").rlike(_checked(pattern)))
    df = df.withColumn("n_matches", F.regexp_count("text", F.lit(pattern)))
    return df if limit is None else df.orderBy("file_path", "start_line", "chunk_id").limit(limit)


def grep_summary(chunks: DataFrame, pattern: str, languages: list[str] | None = None, glob: str | None = None, limit: int = 50) -> DataFrame:
    """total_chunks (after the path filters), matching chunks and whether the result would be cut."""
    df = _scope(chunks, languages, glob)
    return df.agg(F.count("*").alias("total_chunks"), F.count_if(F.col("text").rlike(_checked(pattern))).alias("matching")).withColumn("truncated", F.col("matching") > limit)


def positions(chunks: DataFrame, pattern: str) -> DataFrame:
    """chunk_id, start and end of every match in UTF-8 bytes; only rows that match reach Python."""
    rx = re.compile(_checked(pattern))

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                got, at, size = [], 0, 0
                for m in rx.finditer(t or ""):
                    size += len(t[at : m.start()].encode())
                    n = len(m[0].encode())
                    got.append({"start": size, "end": size + n})
                    size, at = size + n, m.end()
                out.append(got)
            yield pa.array(out, kind)

    hit = chunks.filter(F.col("text").rlike(pattern))
    return hit.select("chunk_id", F.explode(run("text")).alias("m")).select("chunk_id", "m.start", "m.end")
