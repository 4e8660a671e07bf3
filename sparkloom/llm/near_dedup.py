"""Operator 10: near duplicates by circulant MinHash, banding and exact Jaccard.

A document is the set of its 3-word shingles (hashed to 64 bits).  Two fixed
permutations of `DOMAIN` slots make every signature coordinate: `SIGMA`
scatters the shingles once, and coordinate k is the least value of the second
permutation shifted circularly by k.  Coordinates k = 0.. of one slot are
neighbours in memory, so a signature is a row gather and a minimum.  Bands of
`rows` coordinates propose pairs; every pair is verified by its exact Jaccard
similarity; verified pairs are closed transitively into groups.

No key gathers its rows in one task.  One pass over the texts finds, inside each
partition, the copies of one shingle multiset (128-bit fingerprints) and the buckets
of equal band keys, and passes each text on once, and each key once for every
`KEYS_AT_ONCE` keys; so a hot key has a row for some 10,000 documents.  A bucket of m documents doesn't cost m²
verifications: each member is first compared with its least id in the partition, and
these with the least of all.  Only in buckets whose members end in different groups are
the others compared, by the low bytes of their signatures, in blocks of `SIDE` members
inside a task; only pairs that agree in as many coordinates as a pair at the threshold
does, less `SIGMAS` standard deviations (a chance of 1e-12 a pair), are passed on to
exact verification.  Pairs already in one group can't change a group.

Ids are whole numbers; a column of another type is refused.  Nulls: rows with a null id
or text are no document.  An empty text, or one without a word, has no shingle and is in
no group.  Texts of one or two words are one shingle.  Very long texts are hashed whole.
Rows that repeat an id are one document: the union of their shingles; besides, it is
linked to every document that has a text equal to one of its own.  Ties: the least id of
a group is kept.  An empty table gives an empty result; further columns, whatever their
names, are left out by `near_duplicates` and kept as they are by `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import flat, forget, take, whole_ids, written

SHINGLE, THRESHOLD, BANDS, ROWS = 3, 0.5, 50, 4
DOMAIN = 1 << 20
#: Rows up to which the list of documents to verify, or of those that go, is broadcast (some 120 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 250_000
#: Members that one task compares with one hub.
HUB_SHARE = 4096
#: Members of a bucket that one task compares with one another; standard deviations under the expected agreement; keys that a partition gathers before it passes them on (some 100 bytes each); rows of a batch.
SIDE, SIGMAS, KEYS_AT_ONCE, PIECE = 1024, 7.0, 500_000, 1 << 15
COPY, TEXT, KEY, MEMBER = range(4)

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def permutations(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the `width` values that follow each place of the second, going round."""
    if width not in _tables:
        rng = np.random.Generator(np.random.PCG64(20240607))
        sigma = rng.permutation(DOMAIN).astype(np.uint32)
        pi = rng.permutation(DOMAIN).astype(np.uint32)
        around = np.concatenate([pi, pi[: width - 1]])
        _tables[width] = sigma, np.lib.stride_tricks.sliding_window_view(around, width)
    return _tables[width]


def signatures(doc: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(docs, their signatures); `doc` ascends."""
    sigma, rows = permutations(width)
    slot = sigma[(h & np.uint64(DOMAIN - 1)).astype(np.int64)]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    out = np.empty((len(first), width), np.uint32)
    ends = np.r_[first[1:], len(doc)]
    at = 0
    while at < len(first):  # some documents at a time, so that the gathered rows stay in the cache
        to = max(at + 1, int(np.searchsorted(ends, first[at] + 4096, "right")))
        lo, hi = first[at], ends[to - 1]
        if to == at + 1 and hi - lo > 8192:
            best = rows[slot[lo : lo + 8192]].min(axis=0)
            for x in range(lo + 8192, hi, 8192):
                best = np.minimum(best, rows[slot[x : min(x + 8192, hi)]].min(axis=0))
            out[at] = best
        else:
            out[at:to] = np.minimum.reduceat(rows[slot[lo:hi]], first[at:to] - lo, axis=0)
        at = to
    return doc[first] if len(first) else first, out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) 64-bit keys; the band's number is part of the key."""
    part = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), part.shape[:2]).copy()
    for r in range(rows):
        key = tk.mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, r])
    return key.view(np.int64)


def fingerprints(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(documents, 2) 64-bit fingerprints of the multisets of shingles; `doc` ascends."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    return np.stack([np.add.reduceat(tk.mix(h ^ np.uint64(c)), first) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], axis=1).view(np.int64)


_SCHEMA = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("id", pa.int64()), ("other", pa.int64()), ("f", pa.int64()), ("g", pa.int64()), ("sig", pa.binary())])


def _rows(kind: int, n: int, **have) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(n, kind, np.int8)) if x.name == "kind" else have[x.name] if isinstance(have.get(x.name), pa.Array) else pa.array(have[x.name], x.type) if x.name in have else pa.nulls(n, x.type) for x in _SCHEMA], schema=_SCHEMA)


def _buckets(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each key once, with the least and greatest of its ids, and its other ids with the least."""
    by = np.lexsort((ids, keys))
    keys, ids = keys[by], ids[by]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    last = np.r_[first[1:], len(keys)] - 1
    for at in range(0, len(first), PIECE):
        a, b = first[at : at + PIECE], last[at : at + PIECE]
        yield _rows(KEY, len(a), key=keys[a], id=ids[a], other=ids[b])
    hub = np.repeat(ids[first], last - first + 1)
    more = np.flatnonzero((ids != hub) & np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])
    for at in range(0, len(more), PIECE):
        m = more[at : at + PIECE]
        yield _rows(MEMBER, len(m), key=keys[m], id=ids[m], other=hub[m])


def sketch(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """The texts' pass: COPY (id, other: the first id of this text in the partition), TEXT (id, fingerprint f g, low bytes of the signature), KEY and MEMBER rows as of `_buckets`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], int] = {}
        keys, owners, waiting = [], [], 0
        for b in batches:
            for at, texts in tk.steps(b.column(1)):
                ids = b.column(0).slice(at, len(texts)).to_numpy(zero_copy_only=False).astype(np.int64)
                d, h = tk.Words.of(texts).shingles(shingle)
                if not len(d):
                    continue
                some, print_ = ids[np.unique(d)], fingerprints(d, h)
                seen = np.array([met.setdefault(fg, i) for fg, i in zip(map(tuple, print_.tolist()), some.tolist())], np.int64)
                new = np.zeros(len(some), bool)
                new[np.unique(print_, axis=0, return_index=True)[1]] = True
                new &= seen == some
                copy = seen != some
                if copy.any():
                    yield _rows(COPY, int(copy.sum()), id=some[copy], other=seen[copy])
                whole = np.zeros(len(texts), bool)
                whole[np.unique(d)[new]] = True
                d, sig = signatures(d[whole[d]], h[whole[d]], bands * rows)
                if not len(d):
                    continue
                low = (sig & 0xFF).astype(np.uint8)
                yield _rows(TEXT, len(d), id=ids[d], f=print_[new, 0], g=print_[new, 1], sig=pa.array([x.tobytes() for x in low], pa.binary()))
                keys.append(band_keys(sig, bands, rows).ravel())
                owners.append(np.repeat(ids[d], bands))
                waiting += len(keys[-1])
                if waiting >= KEYS_AT_ONCE:
                    yield from _buckets(np.concatenate(keys), np.concatenate(owners))
                    keys, owners, waiting = [], [], 0
        if waiting:
            yield from _buckets(np.concatenate(keys), np.concatenate(owners))
        tk.release()

    return docs.mapInArrow(run, "kind byte, key long, id long, other long, f long, g long, sig binary")


def least_agreement(threshold: float, width: int) -> int:
    """Coordinates in which a pair at the threshold agrees at least, but for a chance of 1e-12."""
    return max(0, int(threshold * width - SIGMAS * (threshold * (1 - threshold) * width) ** 0.5))


def _compare(members: DataFrame, least: int) -> DataFrame:
    """(a, b), a < b, of one bucket, of different roots, that agree in at least `least` coordinates; members: key, id, root, m (members of the bucket), sig."""
    cut = F.greatest(F.lit(1), F.ceil(F.col("m") / SIDE)).cast("int")
    part = F.pmod(F.xxhash64("id"), cut).cast("int")
    some = members.select("key", "id", "root", "sig", part.alias("part"), F.explode(F.sequence(F.lit(0), cut - 1)).alias("with"))
    some = some.select("key", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "id", "root", "sig").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")

    def pairs(group: list[tuple]) -> pa.RecordBatch | None:
        i, j = group[0][1:3]
        ids, root, part = (np.array([g[k] for g in group], np.int64) for k in (4, 5, 3))
        sig = np.frombuffer(b"".join(g[6] for g in group), np.uint8).reshape(len(group), -1)
        x, y = np.flatnonzero(part == i), np.flatnonzero(part == j)
        out = []
        for lo in range(0, len(x), 32):
            to = x[lo : lo + 32]
            fit = root[to, None] != root[None, y]
            if i == j:
                fit &= ids[to, None] < ids[None, y]
            a, b = np.nonzero(fit)
            for k in range(0, len(a), 16384):
                p, q = to[a[k : k + 16384]], y[b[k : k + 16384]]
                good = (sig[p] == sig[q]).sum(axis=1) >= least
                out += [np.stack([ids[p[good]], ids[q[good]]])]
        got = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.record_batch([pa.array(got.min(axis=0)), pa.array(got.max(axis=0))], ["a", "b"]) if got.shape[1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if group and group[0][:3] != row[:3]:
                    if (got := pairs(group)) is not None:
                        yield got
                    group = []
                group.append(row)
        if group and (got := pairs(group)) is not None:
            yield got

    return some.mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The (a, b) of `pairs` whose exact Jaccard similarity is at least `threshold`, with it as `j`."""
    share = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_SHARE).alias("n"))
    salted = pairs.join(share, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("n")))
    want = salted.select("a", "salt", F.col("b").alias("id"), F.lit(1).alias("member")).unionByName(salted.select("a", "salt", F.col("a").alias("id"), F.lit(0).alias("member")).distinct())
    want = written(want, "want")
    rows = docs.join(F.broadcast(want) if want.count() <= BROADCAST_IDS else want, "id").repartition("a", "salt").sortWithinPartitions("a", "salt", "member", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"hub": None, "set": np.zeros(0, np.uint64), "id": None, "own": None}

        def close() -> tuple | None:
            if state["id"] is None:
                return None
            x, y = state["set"], state["own"]
            both = len(np.intersect1d(x, y, assume_unique=True))
            j = both / max(1, len(x) + len(y) - both)
            return (state["hub"][0], state["id"], j) if j >= threshold else None

        for b in batches:
            found = []
            a, salt, member, who = (b.column(k).to_numpy(zero_copy_only=False) for k in ("a", "salt", "member", "id"))
            for at, texts in tk.steps(b.column("text")):
                d, h = tk.set_of(*tk.Words.of(texts).shingles(shingle))
                cut = np.searchsorted(d, np.arange(len(texts) + 1))
                for k in range(len(texts)):
                    i, own = at + k, h[cut[k] : cut[k + 1]]
                    hub = (int(a[i]), int(salt[i]))
                    if member[i] == 0:
                        if state["hub"] == hub and state["id"] is None:
                            state["set"] = np.union1d(state["set"], own)
                        else:
                            found.append(close())
                            state |= {"hub": hub, "set": own, "id": None}
                    elif state["id"] == int(who[i]) and state["hub"] == hub:
                        state["own"] = np.union1d(state["own"], own)
                    else:
                        found.append(close())
                        state |= {"id": int(who[i]), "own": own}
            found = [x for x in found if x]
            if found:
                yield pa.RecordBatch.from_pylist([dict(zip("abj", x)) for x in found])
        if last := close():
            yield pa.RecordBatch.from_pylist([dict(zip("abj", last))])

    out = written(rows.select("a", "salt", "member", "id", "text").mapInArrow(run, "a long, b long, j double"), "verified")
    forget(want)
    return out


def _with_least(e: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least v of u: summed up before the shuffle, and joined, so that a hub's edges can be split."""
    return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of each node's connected component, by alternating large and small stars; a root itself has no row."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = written(small, "edges")
        forget(e)
        e = now
        mark = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if mark == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = mark


def _named(df: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """These id columns replaced by their root, where they have one."""
    for c in columns:
        df = df.join(names.select(F.col("id").alias(c), F.col("root").alias("_root")), c, "left").withColumn(c, F.coalesce("_root", c)).drop("_root")
    return df


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each document that has a near duplicate: its id, `group_id` (the least id of its group) and `kept`, true for that one."""
    d = whole_ids(take(docs, id_col, text_col).toDF("id", "text"), "id").filter("id IS NOT NULL AND text IS NOT NULL")
    all_ = written(sketch(d, shingle, bands, rows), "sketch")
    text, member = all_.filter(F.col("kind") == TEXT), all_.filter(F.col("kind") == MEMBER).select("key", "id", F.col("other").alias("hub"))
    copies = all_.filter(F.col("kind") == COPY).select("id", F.col("other").alias("root"))
    first_id = text.groupBy("f", "g").agg(F.min("id").alias("root"), F.count("*").alias("n")).filter("n > 1")
    classes = written(text.select("f", "g", "id").join(first_id, ["f", "g"]).filter("id <> root").select("id", "root").distinct(), "classes")
    w = Window.partitionBy("key")
    bucket = all_.filter(F.col("kind") == KEY).select("key", "id", "other").repartition("key").withColumn("hub", F.min("id").over(w)).withColumn("top", F.max("other").over(w)).filter("hub < top").select("key", "id", "hub")
    bucket = written(bucket, "buckets")
    pairs = bucket.filter("id > hub").unionByName(member).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    pairs = _named(pairs, classes, "a", "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = written(pairs, "stars")
    first = verified(d, stars, shingle, threshold)
    same = classes.select(F.col("root").alias("a"), F.col("id").alias("b"))
    edges = first.select("a", "b").unionByName(same)
    root = written(components(edges), "roots")
    # the other pairs of buckets whose members are of several groups
    seen = bucket.select("key", "id").unionByName(member.select("key", "id"))
    seen = written(seen.join(root, "id", "left").withColumn("root", F.coalesce("root", "id")), "members")
    mixed = seen.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key", "m")
    mixed = _named(seen.join(mixed, "key"), classes, "id").distinct()
    rest = _compare(mixed.join(text.select("id", "sig"), "id"), least_agreement(threshold, bands * rows)).distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti")
    rest = written(rest, "rest")
    second = verified(d, rest, shingle, threshold)
    if not second.isEmpty():
        forget(root)
        root = written(components(edges.unionByName(second.select("a", "b"))), "roots")
    forget(bucket, seen, rest, stars, first, second)
    ends = root.unionByName(root.select(F.col("root").alias("id"), "root").distinct())
    far = copies.join(ends.select(F.col("id").alias("root"), F.col("root").alias("end")), "root", "left").select("id", F.coalesce("end", "root").alias("root"))
    alone = copies.select(F.col("root").alias("id"), "root").distinct().join(ends, "id", "left_anti")
    nodes = written(ends.unionByName(far).unionByName(alone).distinct(), "nodes")
    forget(all_, classes, root)
    # the first of a partition's copies isn't always their least, and an id may have several texts
    ids = nodes.groupBy("id").agg(F.min("root").alias("root"), F.max("root").alias("more"))
    if not ids.filter("root <> more").isEmpty():
        again = components(ids.filter("root <> more").join(nodes.select("id", F.col("root").alias("b")), "id").select(F.col("root").alias("a"), "b"))
        nodes, before = written(_named(nodes, again, "root").distinct(), "nodes"), nodes
        forget(before)
    least = nodes.groupBy("root").agg(F.min("id").alias("group_id"))
    return nodes.join(least, "root").select(F.col("id").alias("doc_id"), "group_id", (F.col("id") == F.col("group_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` without the documents of a group other than its least id.  Rows with a null id stay."""
    gone = written(near_duplicates(docs, id_col=id_col, text_col=text_col, **how).filter("NOT kept").select(F.col("doc_id").alias("gone")), "gone")
    table, names = flat(docs)
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return table.join(gone, F.col(f"c{names.index(id_col)}").cast("long") == F.col("gone"), "left_anti").toDF(*names)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
