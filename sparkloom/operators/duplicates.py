"""Near-duplicate chunks by cosine, compared block by block."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import shared

BLOCK = 2048
#: Rows of a block that are multiplied, and whose matches are picked, at once.
SLAB = 128
#: Bytes of blocks for a task, and so in a batch, on average.
TASK_BYTES = 8 << 20


def partition_of(kind: Column) -> Column:
    return F.when(kind.isin("function", "method"), "callable").when(kind == "type", "type").otherwise("other")


def candidates(chunks: DataFrame, *, min_bytes: int = 100, text_col: str | None = "text") -> DataFrame:
    """The chunks that are compared: with an embedding and a text of at least `min_bytes`; of chunks known by their vectors only (`text_col` None) all."""
    df = chunks.filter(F.col("embedding").isNotNull())
    return df if text_col is None else df.filter(F.octet_length(text_col) >= min_bytes)


def _pack(df: DataFrame) -> DataFrame:
    """part, block, blocks, ids, names and m: the vectors of each block, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch:
            ids, names, m = (np.concatenate([h[k] for h in held]) for k in range(3))
            return pa.record_batch([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()), pa.array([ids.tobytes()]), pa.array([names.tobytes()]), pa.array([m.tobytes()])], ["part", "block", "blocks", "ids", "names", "m"])

        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in ("part", "block", "blocks"))))
            cut = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for lo, hi in zip(cut, cut[1:]):
                if lo == hi:
                    continue
                if key != keys[lo] and held:
                    yield close()
                    held = []
                key = keys[lo]
                v = b.column("v").slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False)
                held.append((b.column("chunk_id").slice(lo, hi - lo).to_numpy(), b.column("name").slice(lo, hi - lo).to_numpy(), v))
        if held:
            yield close()

    rows = df.repartition("part", "block").sortWithinPartitions("part", "block", "chunk_id")
    return rows.select("part", "block", "blocks", "chunk_id", "name", "v").mapInArrow(run, "part string, block int, blocks int, ids binary, names binary, m binary")


def _billionths(like: np.ndarray) -> np.ndarray:
    """Similarities in whole billionths, as Spark's `round(similarity, 9)` has them: halves go up in the decimal digits."""
    scaled = np.abs(like) * 1e9 + 0.5
    out = np.floor(scaled)
    for k in np.flatnonzero(np.abs(scaled - np.rint(scaled)) <= 1e-5 + scaled * 1e-15):  # too near a half for binary digits
        out[k] = float(Decimal(repr(float(abs(like[k])))).scaleb(9).to_integral_value(ROUND_HALF_UP))
    return np.copysign(out, like)


def _best(s: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the `k` best entries of each row that fit, of equal ones those further left."""
    if fits.shape[1] > k:
        least = np.partition(np.where(fits, s, -np.inf), -k, axis=1)[:, -k, None]
        fits = fits & (s >= least - 2e-9 - np.abs(least) * 1e-15)
    x, y = np.nonzero(fits)
    order = np.lexsort((y, -_billionths(s[x, y]), x))
    x, y = x[order], y[order]
    keep = np.arange(len(x)) - np.searchsorted(x, x) < k
    return x[keep], y[keep]


def find_duplicates(chunks: DataFrame, *, file: str | None = None, min_similarity: float = 0.85, min_bytes: int = 100, per_chunk: int = 5, text_col: str | None = "text") -> DataFrame:
    """source_id, match_id, rank and similarity: up to `per_chunk` matches of each source, both directions.

    Chunks compare inside their partition (callable, type, other).  Each
    partition is packed into blocks of about `BLOCK` vectors, and a pair of
    blocks meets in one task, which multiplies `SLAB` rows at a time.  Without a scope each pair
    meets once, for both directions.  Only the best `per_chunk` of a source leave a pair of
    blocks, and there are as many tasks as give each about `TASK_BYTES`: memory grows neither
    with the number of blocks nor with that of similar pairs.  A scope restricts the sources, not the
    candidates: only its file's chunks lie on the left then.  The same file and symbol
    path is no match.
    """
    df = candidates(chunks, min_bytes=min_bytes, text_col=text_col)
    df = df.select("chunk_id", "file_path", F.xxhash64(F.concat_ws("\x00", "file_path", "symbol_path")).alias("name"), partition_of(F.col("kind")).alias("part"), F.col("embedding").cast("array<double>").alias("v"))
    df = shared(df, "vectors")  # is counted and packed

    def sizes(rows: DataFrame) -> DataFrame:
        return rows.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max(F.size("v")).alias("width"))

    def blocked(rows: DataFrame) -> DataFrame:
        return _pack(rows.join(F.broadcast(sizes(rows).drop("width")), "part").withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int")))

    right, all_ = blocked(df), sizes(df).collect()
    columns = ["part", "i", "j", "side", "ids", "names", "m"]
    number = lambda lo, hi: F.explode(F.sequence(lo, hi))
    if file is None:
        a = right.select("part", F.col("block").alias("i"), number(F.col("block"), F.col("blocks") - 1).alias("j"), F.lit(0).alias("side"), "ids", "names", "m")
        b = right.select("part", number(F.lit(0), F.col("block")).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "ids", "names", "m")
    else:
        left = blocked(df.filter(F.col("file_path") == file))
        many = lambda x, name: x.groupBy("part").agg(F.max("blocks").alias(name))
        a = left.join(F.broadcast(many(right, "n")), "part").select("part", F.col("block").alias("i"), number(F.lit(0), F.col("n") - 1).alias("j"), F.lit(0).alias("side"), "ids", "names", "m")
        b = right.join(F.broadcast(many(left, "n")), "part").select("part", number(F.lit(0), F.col("n") - 1).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "ids", "names", "m")
    few = {r.part: r.blocks for r in (all_ if file is None else sizes(df.filter(F.col("file_path") == file)).collect())}
    pairs = lambda r: r.blocks * (r.blocks + 1) // 2 if file is None else r.blocks * few.get(r.part, 0)
    n_tasks = 1 + sum(pairs(r) * 2 * BLOCK * 8 * (r.width + 2) for r in all_) // TASK_BYTES
    tasks = a.unionByName(b).repartition(n_tasks, "part", "i", "j").sortWithinPartitions("part", "i", "j", "side").select(*columns)
    twice = file is None

    def matches(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(left[0]), SLAB):
            s = left[2][lo : lo + SLAB] @ right[2].T
            x, y = _best(s, (s >= min_similarity) & (left[1][lo : lo + SLAB, None] != right[1][None, :]), per_chunk)
            yield pa.record_batch([pa.array(left[0][lo + x]), pa.array(right[0][y]), pa.array(s[x, y])], ["source_id", "match_id", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for k in range(batch.num_rows):
                at = {c: batch.column(c)[k] for c in columns}
                ids, names = (np.frombuffer(at[c].as_buffer(), np.int64) for c in ("ids", "names"))
                m = np.frombuffer(at["m"].as_buffer(), np.float64).reshape(len(ids), -1)
                if at["side"].as_py() == 0:
                    held = (ids.copy(), names.copy(), m.copy())  # the batch goes before its pair may come
                    continue
                yield from matches(held, (ids, names, m))
                if twice and at["i"].as_py() != at["j"].as_py():
                    yield from matches((ids, names, m), held)
            batch = at = ids = names = m = None  # before the next one comes

    found = tasks.mapInArrow(run, "source_id long, match_id long, similarity double")
    w = Window.partitionBy("source_id").orderBy(F.desc(F.round("similarity", 9)), "match_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_chunk).select("source_id", "match_id", "rank", "similarity")


def compared(chunks: DataFrame, **how) -> DataFrame:
    """One row: how many chunks were compared."""
    return candidates(chunks, **how).agg(F.count("*").alias("compared"))


def groups(found: DataFrame) -> DataFrame:
    """One row for each source, best first: its best similarity, number of matches and their ids in order."""
    g = found.groupBy("source_id").agg(F.max("similarity").alias("best"), F.count("*").alias("n"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "match_id"))), lambda x: x["match_id"])).alias("matches"))
    return g.orderBy(F.desc(F.round("best", 9)), "source_id")
