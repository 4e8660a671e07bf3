"""Operator 2: nearest neighbours by a block matrix join of int8 tiles.

Queries are the rows whose id is divisible by `EVERY`; each is compared with every row.
Unit vectors are quantised to int8, one scale a vector, in blocks of `ROWS` rows.  Each
tile, a block of queries against a block of candidates, is a product of integers (exact
in float32 arithmetic: at most 127 * 127 * dims < 2^24 for up to 1040 dims; longer
vectors use float64).  With the norms of what rounding took away, a product bounds the
true cosine from below and above.  Pairs whose upper bound is under the query's K-th
lower bound so far can't be neighbours; the survivors are recomputed in float64 and
merged into the query's heap.  So the neighbours are those of brute force (recall 1).

Queries are cut into chunks of at most `CHUNK` bytes of vectors, candidates into shares;
a task takes one chunk, which stays in memory, and one share, which streams past it
block by block.  A candidate is moved once for each chunk of queries, that is once
while the queries fit in a chunk; K rows a query and share go on to the last merge.  The
work is the number of queries times the number of rows.

Ids are whole numbers; a column of another type is refused.  Vectors are read as
float32.  Nulls: rows with a null id or vector, a vector with a null or non-finite value
(or one beyond float32), a zero vector, or one of another length than the most frequent
(of equally frequent ones the shortest) have no neighbours and are no neighbour.  Rows
that repeat an id count once (their least vector).  Ties: cosines equal to 9 digits are
ordered by id.  An empty table gives an empty result; further columns, whatever their
names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import take, whole_ids, written

K, ROWS, EVERY, CHUNK, SHARES = 10, 2048, 100, 64 << 20, 8


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, norms of the rounding errors)."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def tile(q, sq, eq, c, sc, ec) -> tuple[np.ndarray, np.ndarray]:
    """(approximate cosines, error bounds) of two quantised blocks of unit vectors.

    x.y = (x' + u).(y' + v), so |x.y - x'.y'| <= |u| + |v| (1 + |u|), as |y| = 1 and |x'| <= 1 + |u|.
    """
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    dot = (q.astype(kind) @ c.astype(kind).T).astype(np.float64)
    dot *= sq[:, None]
    dot *= sc[None, :]
    return dot, eq[:, None] + ec[None, :] * (1 + eq[:, None]) + 1e-9


class Heaps:
    """The k best (cosine, id) of each query."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]
        self.worst = np.full(n, -np.inf)  # k-th best cosine; nothing under it can enter

    def offer(self, i: int, cosine: float, other: int) -> None:
        h, item = self.heaps[i], (cosine, -other)
        if len(h) < self.k:
            heappush(h, item)
        elif item > h[0]:
            heapreplace(h, item)
        if len(h) == self.k:
            self.worst[i] = h[0][0]


class Block:
    """Some vectors (raw float32), their ids, norms and quantised forms."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray):
        self.ids, self.raw = ids, raw
        self.norm = np.linalg.norm(raw.astype(np.float64), axis=1)
        parts = [quantise(raw[k : k + ROWS] / self.norm[k : k + ROWS, None]) for k in range(0, len(ids), ROWS)]
        self.quant = tuple(np.concatenate(p) for p in zip(*parts))

    def cosines(self, a: np.ndarray, other: "Block", b: np.ndarray) -> np.ndarray:
        """Of pairs, in float64, to 9 digits."""
        dot = np.einsum("ij,ij->i", self.raw[a].astype(np.float64), other.raw[b].astype(np.float64))
        return np.round(dot / (self.norm[a] * other.norm[b]), 9)


def match(q: Block, c: Block, heaps: Heaps) -> None:
    """Offers the candidates to the queries' heaps, whatever can enter."""
    for lo in range(0, len(q.ids), ROWS):
        to = slice(lo, lo + ROWS)
        dot, err = tile(*(z[to] for z in q.quant), *c.quant)
        upper = dot + err
        same = q.ids[to, None] == c.ids[None, :]
        upper[same] = -np.inf
        floor = heaps.worst[to]
        if len(c.ids) > heaps.k:
            lower = np.where(same, -np.inf, dot - err)
            floor = np.maximum(floor, np.partition(lower, -heaps.k, axis=1)[:, -heaps.k])
        a, b = np.nonzero((upper >= (floor - 1e-9)[:, None]) & ~same)
        for i, x, o in zip((a + lo).tolist(), q.cosines(a + lo, c, b).tolist(), c.ids[b].tolist()):
            heaps.offer(i, x, o)


def neighbours(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = 1, rows: int = ROWS, chunk_bytes: int = CHUNK, shares: int | None = None) -> DataFrame:
    """vec_id, rank (from 1), neighbour_id and similarity: the k nearest rows by cosine of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    v = whole_ids(take(vectors, id_col, vector_col).toDF("id", "v"), "id").withColumn("v", F.col("v").cast("array<float>"))
    v = v.filter("id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND abs(x) < CAST('Infinity' AS FLOAT)) AND exists(v, x -> x <> 0)")
    v = written(v.groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v")), "vectors")
    asked = F.col("id") % every == 0
    most = v.groupBy("d").agg(F.count("*").alias("n"), F.count_if(asked).alias("asked")).orderBy(F.desc("n"), "d").first()
    if most is None or not most["asked"]:
        return spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, similarity double")
    dims = int(most["d"])
    chunks = -(-int(most["asked"]) * dims * 4 // chunk_bytes)
    shares = shares or max(SHARES, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // chunks))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column(2).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            got = [(int(p), i) for p in np.unique(part) for whole in [np.flatnonzero(part == p)] for i in np.split(whole, range(rows, len(whole), rows))]
            for p, i in got:
                yield pa.record_batch([pa.array([p], pa.int32()), pa.array([int(ids[i[0]])]), pa.array([ids[i].tobytes()]), pa.array([x[i].tobytes()])], ["part", "block", "ids", "m"])

    def packed(df: DataFrame, part) -> DataFrame:
        return df.select("id", "v", part.alias("part")).mapInArrow(pack, "part int, block long, ids binary, m binary")

    v = v.filter(F.col("d") == dims)
    every_chunk, every_share = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))), F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    q = packed(v.filter(asked), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).select(F.col("part").alias("chunk"), every_share.alias("share"), F.lit(0).alias("side"), "block", "ids", "m")
    c = packed(v, F.lit(0)).select(every_chunk.alias("chunk"), F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("side"), "block", "ids", "m")
    tasks = q.unionByName(c).repartition(chunks * shares, "chunk", "share").sortWithinPartitions("chunk", "share", "side", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, waiting, queries, heaps = None, [], None, None

        def result() -> pa.RecordBatch:
            found = [(int(queries.ids[i]), -o, s) for i, h in enumerate(heaps.heaps) for s, o in h]
            return pa.record_batch([pa.array([x[j] for x in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["vec_id", "neighbour_id", "similarity"])

        for b in batches:
            for chunk, share, side, ids, m in zip(*(b.column(j).to_pylist() for j in (0, 1, 2, 4, 5))):
                if of != (chunk, share):
                    if heaps:
                        yield result()
                    of, waiting, queries, heaps = (chunk, share), [], None, None
                ids, m = np.frombuffer(ids, np.int64), np.frombuffer(m, np.float32).reshape(-1, dims)
                if side == 0:
                    waiting.append((ids, m))
                elif waiting:
                    if heaps is None:
                        queries = Block(*(np.concatenate(z) for z in zip(*waiting)))
                        heaps = Heaps(len(queries.ids), k)
                    match(queries, Block(ids, m), heaps)
        if heaps:
            yield result()

    part = tasks.mapInArrow(run, "vec_id long, neighbour_id long, similarity double")
    w = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour_id")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", F.round("similarity", 6).alias("similarity"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every row whose id is divisible by EVERY, among all rows."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=EVERY)


SQL2 = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS size FROM e),
p AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_inner_product(a.v, b.v) / (a.size * b.size), 9) AS s
  FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour_id) AS k FROM p)
SELECT vec_id, CAST(k AS INTEGER) AS rank, neighbour_id, round(s, 6) AS similarity FROM r WHERE k <= {K}
"""
