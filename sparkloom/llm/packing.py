"""Operator 9: best-fit packing after Martello-Toth dominance reduction.

Documents are packed into sequences of `CAPACITY` bytes (one byte is one token
of a byte-level model; another length column may be given).  A document longer
than a sequence fills whole sequences and leaves one shorter piece; nothing is
cut otherwise.  A bin set *dominates* the others with the same item if
some optimal packing uses it, so it may be fixed for good:

1. an item that fits with no other is alone;
2. two items that fill a bin exactly;
3. an item with the largest that fits beside it, if at most one more
   fits, or if no two that fit beside it are together longer than that one;
4. an item with the largest two that fit, if whatever else could lie
   beside it is dominated piece by piece.

Items are tried from the longest on, each against all that are left; one that no rule
fixes is set aside, and the next is tried.  What is left is packed best-fit decreasing.
The rules settle items beside which at most two others fit, so many short documents
leave most of the work to best-fit.  All of this depends on
lengths only, so the driver works on the histogram of lengths (at most CAPACITY
rows, whatever the table's size) with multiplicities, and a plan of runs of
equal bins comes out.  Documents then get their bins by their rank among those
of equal length: the numbers of earlier partitions, summed by length, and the place
inside their own partition, so no length gathers its documents in one task.  The plan
is broadcast (it is bounded by the histogram).

Nulls: a null or empty text has length 0 and is in no bin (no row).  Rows with a
null id are packed like others.  Repeated rows are packed separately; `row`, a number of
the table's rows, tells them apart.  Ties: documents of one length are taken in the
order of the table's rows.  Very long texts fill bins of their own, and their rest is
packed like a short text.  An empty table gives an empty result; further columns,
whatever their names, are left out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import take, written

CAPACITY = 16384


class _Sizes:
    """Counts by size with the largest, the smallest and the largest up to a bound."""

    def __init__(self, histogram: dict[int, int]):
        self.count = {s: n for s, n in histogram.items() if n > 0}
        self.order = sorted(self.count)

    def use(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.order.pop(bisect_left(self.order, size))

    def up_to(self, bound: int, without: tuple[int, ...] = ()) -> int:
        """The largest size of at most `bound` that is left after taking `without`; 0 if none."""
        k = bisect_right(self.order, bound)
        while k:
            k -= 1
            s = self.order[k]
            if self.count[s] > without.count(s):
                return s
        return 0

    def least(self, n: int, without: tuple[int, ...]) -> list[int]:
        """The `n` smallest items besides `without`."""
        out: list[int] = []
        for s in self.order:
            out += [s] * min(n - len(out), self.count[s] - without.count(s))
            if len(out) == n:
                break
        return out


def _best_two(sizes: _Sizes, room: int, big: int) -> tuple[int, int]:
    """Two items besides one of size `big` with the greatest sum of at most `room`; (0, 0) if none."""
    best = (0, 0)
    for s in reversed(sizes.order[: bisect_right(sizes.order, room)]):
        if 2 * s < sum(best):
            break
        if sizes.count[s] <= (s == big):
            continue
        t = sizes.up_to(min(s, room - s), (big, s))
        if t and s + t > sum(best):
            best = (s, t)
            if s + t == room:
                break
    return best


def reduce(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(fixed bins with multiplicities, the remaining histogram)."""
    sizes, fixed = _Sizes(histogram), []

    def fix(items: tuple[int, ...], n: int) -> None:
        for s in items:
            sizes.use(s, n)
        fixed.append((items, n))

    for s in reversed(list(sizes.order)):  # rule 2, and items as long as a bin
        if s == capacity:
            fix((s,), sizes.count[s])
        elif 2 * s > capacity and (n := min(sizes.count[s], sizes.count.get(capacity - s, 0))):
            fix((s, capacity - s), n)
        elif 2 * s == capacity and (n := sizes.count.get(s, 0) // 2):
            fix((s, s), n)
    bound = capacity
    while big := sizes.up_to(bound):
        room = capacity - big
        other = sizes.up_to(room, (big,))
        if not other:
            fix((big,), 1 if 2 * big <= capacity else sizes.count[big])
            continue
        few = sizes.least(3, (big,))
        n = sizes.count[big] // 2 if other == big else min(sizes.count[big], sizes.count[other])
        if len(few) < 2 or few[0] + few[1] > room or other == room:
            fix((big, other), n)
            continue
        if len(few) < 3 or sum(few) > room:
            two = _best_two(sizes, room, big)
            if sum(two) <= other:
                fix((big, other), 1)
                continue
            third = sizes.up_to(room - other, (big, other))
            if third:
                k = bisect_right(sizes.order, third)
                above = sizes.order[k] if k < len(sizes.order) else capacity
                if 2 * above > room:
                    fix((big, other, third), 1)
                    continue
        bound = big - 1
    return fixed, dict(sizes.count)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing with multiplicities: items in descending order, each into the fullest bin that has room."""
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by room left
    rooms: list[int] = []

    def put(room: int, items: tuple[int, ...], n: int) -> None:
        if n and items not in bins[room]:
            if not bins[room]:
                insort(rooms, room)
            bins[room][items] = 0
        if n:
            bins[room][items] += n

    for s in sorted(histogram, reverse=True):
        left = histogram[s]
        while left:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                each = capacity // s
                put(capacity - each * s, (s,) * each, left // each)
                if left % each:
                    put(capacity - left % each * s, (s,) * (left % each), 1)
                break
            room = rooms[k]
            items = next(iter(bins[room]))
            have = bins[room].pop(items)
            if not bins[room]:
                rooms.pop(k)
            each = room // s
            full = min(have, left // each)
            put(room - each * s, items + (s,) * each, full)
            have, left = have - full, left - full * each
            if have and left:  # fewer than `each` are left
                put(room - left * s, items + (s,) * left, 1)
                have, left = have - 1, 0
            put(room, items, have)
    return [(items, n) for by in bins.values() for items, n in by.items()]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Runs of equal bins: (sizes, number of bins)."""
    fixed, rest = reduce(histogram, capacity)
    return fixed + best_fit(rest, capacity)


def _slots(runs: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """By (size, first rank): where ranks from there on go."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for items, n in runs:
        at = 0
        each: dict[int, list[int]] = defaultdict(list)
        for s in items:
            each[s].append(at)
            at += s
        for s, places in each.items():
            for offset in places:
                rows.append((s, used[s], base, offset))
                used[s] += n
        base += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"size": a[:, 0], "rank": a[:, 1], "bin": a[:, 2], "offset": a[:, 3]}


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, row, piece, bin_id, bin_offset and n_bytes.

    A piece that fills a bin alone because its document is longer has a bin named
    after the document (`doc:row:piece`); other bins have numbers.
    """
    size = F.octet_length(F.col("t")) if length_col is None else F.col("t")
    d = take(docs, id_col, length_col or text_col).toDF("doc_id", "t").select("doc_id", F.coalesce(size, F.lit(0)).cast("long").alias("n")).filter("n > 0")
    d = written(d.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "lengths")
    whole = F.expr(f"n div {capacity}")
    full = d.filter(F.col("n") >= capacity).select("doc_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece"))
    full = full.select("doc_id", "row", "piece", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "row", "piece").alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"), F.lit(capacity).cast("long").alias("n_bytes"))
    rest = d.select("doc_id", "row", "part", whole.alias("piece"), (F.col("n") % capacity).alias("n_bytes")).filter("n_bytes > 0")
    number = rest.groupBy("part", "n_bytes").count()
    histogram = {int(r[0]): int(r[1]) for r in number.groupBy("n_bytes").agg(F.sum("count")).collect()}
    slots = docs.sparkSession.sparkContext.broadcast(_slots(plan(histogram, capacity), capacity))
    before = Window.partitionBy("n_bytes").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    number = number.select("part", "n_bytes", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part", "n_bytes").orderBy("row")).cast("long") - 1
    ranked = rest.withColumn("inside", inside).join(number, ["part", "n_bytes"]).select("doc_id", "row", "piece", "n_bytes", (F.col("inside") + F.col("before")).alias("r"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        width = np.int64(1) << 40
        starts = s["size"] * width + s["rank"]
        for b in batches:
            n, r = (b.column(k).to_numpy(zero_copy_only=False) for k in ("n_bytes", "r"))
            k = np.searchsorted(starts, n * width + r, "right") - 1
            name = pa.array((s["bin"][k] + r - s["rank"][k])).cast(pa.string())
            yield pa.record_batch([b.column("doc_id"), b.column("row"), b.column("piece"), name, pa.array(s["offset"][k]), b.column("n_bytes")], ["doc_id", "row", "piece", "bin_id", "bin_offset", "n_bytes"])

    kind = dict(d.dtypes)["doc_id"]
    packed = ranked.mapInArrow(place, f"doc_id {kind}, row long, piece long, bin_id string, bin_offset long, n_bytes long")
    return packed.unionByName(full)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
