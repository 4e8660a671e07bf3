"""Debounced file events, settling and versions, over stored tables and as streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tree import ancestors, visible

BUCKET_GAPS = 1000


def millis(df: DataFrame, name: str) -> Column:
    """Milliseconds of a time with or without a zone, to the nearest; halves go away from 1970."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        micros = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {name})"
    else:
        micros = f"unix_micros({name})"
    return F.expr(f"({micros} + CASE WHEN {micros} < 0 THEN -500 ELSE 500 END) div 1000")


def sessions(events: DataFrame, gap_ms: int) -> DataFrame:
    """`events` (seq, ts, ...) with `session`: one global timer, so a session ends where no event at all comes for `gap_ms`.

    Time is cut into buckets of BUCKET_GAPS gaps.  Gaps inside a bucket are found in it;
    those between buckets, and the numbers of earlier sessions, come from one
    row a bucket: a thousandth of the time range in gaps.  No task sees all events.
    """
    e = events.withColumn("_t", millis(events, "ts")).withColumn("_b", F.floor(F.col("_t") / (gap_ms * BUCKET_GAPS)))
    w = Window.partitionBy("_b").orderBy("_t", "seq")
    edge = Window.orderBy("_b")
    ends = e.groupBy("_b").agg(F.max("_t").alias("_last")).withColumn("_before", F.lag("_last").over(edge)).select("_b", "_before")
    e = e.join(ends, "_b").withColumn("_prev", F.coalesce(F.lag("_t").over(w), F.col("_before")))
    e = e.withColumn("_new", F.when(F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") >= gap_ms), 1).otherwise(0))
    starts = e.groupBy("_b").agg(F.sum("_new").alias("_n")).withColumn("_done", F.coalesce(F.sum("_n").over(edge.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_done")
    e = e.join(starts, "_b").withColumn("session", (F.col("_done") + F.sum("_new").over(w)).cast("long"))
    return e.drop("_t", "_b", "_before", "_prev", "_new", "_done")


def debounce(events: DataFrame, gap_ms: int) -> DataFrame:
    """session, path, kind and seq: the last event of each path in each session."""
    last = F.max(F.struct("ts", "seq", "kind"))
    return sessions(events, gap_ms).groupBy("session", "path").agg(last.alias("l")).select("session", "path", F.col("l.kind").alias("kind"), F.col("l.seq").alias("seq"))


def accepted(events: DataFrame, extensions: list[str], root: str = "", rules: DataFrame | None = None) -> DataFrame:
    """Events on known files under the root that are neither hidden nor ignored, with paths below the root."""
    if root:
        events = events.filter(F.startswith("path", F.lit(root + "/"))).withColumn("path", F.substring("path", len(root) + 2, 1 << 30))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    fine = events.filter(ext.isin(extensions) & ~F.concat(F.lit("/"), F.col("path")).rlike(r"/\."))
    if rules is None:
        return fine
    up = fine.select(F.explode(ancestors(F.col("path"))).alias("up"), "path").select(F.col("up").alias("path"), (F.col("up") != F.col("path")).alias("is_dir")).distinct()
    return fine.join(visible(up, rules), "path", "left_semi")


def debounce_stream(events: DataFrame, gap_ms: int) -> DataFrame:
    """The same on a stream with an event-time watermark: a session comes out once time has passed its end.

    The timer is global by definition, so the state has one key; it holds the
    last event of each path of the open session.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        number, last, held = state.get if state.exists else (0, -1, "{}")
        open_ = {p: tuple(x) for p, x in json.loads(held).items()}
        out = []

        def close() -> None:
            nonlocal number
            if open_:
                number += 1
                out.extend((number, p, k, s) for p, (t, s, k) in sorted(open_.items()))
                open_.clear()

        if state.hasTimedOut:
            close()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
            micros = rows["ts"].astype("datetime64[us]").astype("int64")
            for t, s, p, k in zip(np.sign(micros) * ((micros.abs() + 500) // 1000), rows["seq"], rows["path"], rows["kind"]):
                if open_ and t - last >= gap_ms:
                    close()
                last = max(last, int(t))
                open_[p] = max(open_.get(p, (-1, -1, "")), (int(t), int(s), k))
        state.update((number, last, json.dumps(open_)))
        if open_:
            state.setTimeoutTimestamp(max(last + gap_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session", "path", "kind", "seq"])

    one = events.withColumn("_one", F.lit(1)).groupBy("_one")
    return one.applyInPandasWithState(run, "session long, path string, kind string, seq long", "number long, last long, held string", "append", "EventTimeTimeout")


def settle(updates: DataFrame, quiet_ms: int = 300, deadline_ms: int = 5000) -> DataFrame:
    """request, outcome and at_ms: when each request's watched updates fell quiet.

    `updates` has request and at_ms, counted from the request's start, and a null at_ms for a request without
    updates.  The first pause of `quiet_ms`, the one before the first update
    included, settles, if it ends before the deadline; else the request is pending at it.
    """
    w = Window.partitionBy("request").orderBy("at_ms")
    starts = updates.select("request").distinct().withColumn("at_ms", F.lit(0).cast("long"))
    u = updates.filter(F.col("at_ms").isNotNull() & (F.col("at_ms") < deadline_ms)).select("request", F.col("at_ms").cast("long").alias("at_ms"))
    u = starts.unionByName(u).withColumn("next", F.lead("at_ms").over(w))
    quiet = F.min(F.when(F.col("next").isNull() | (F.col("next") - F.col("at_ms") >= quiet_ms), F.col("at_ms") + quiet_ms))
    done = u.groupBy("request").agg(quiet.alias("end"))
    ok = F.col("end") <= deadline_ms
    return done.select("request", F.when(ok, "settled").otherwise("pending").alias("outcome"), F.when(ok, F.col("end")).otherwise(F.lit(deadline_ms)).alias("at_ms"))


def latest(updates: DataFrame, key: str, *values: str) -> DataFrame:
    """The last values of each key, by (ts, seq): a cache that replaces."""
    return updates.groupBy(key).agg(F.max(F.struct("ts", "seq", *values)).alias("l")).select(key, *[F.col(f"l.{v}").alias(v) for v in values])


#: Codes by which a server says that it is still loading.
NOT_READY = (-32802, -32801)


def server_ready(responses: DataFrame) -> DataFrame:
    """server and ready by its last response (server, ts, seq, error_code): not after a code of `NOT_READY`; other errors change nothing, and a server without an answer isn't ready."""
    told = F.col("error_code").isNull() | F.col("error_code").isin(*NOT_READY)
    last = F.max(F.when(told, F.struct("ts", "seq", F.col("error_code").isNull().alias("ready"))))
    return responses.groupBy("server").agg(last.alias("l")).select("server", F.coalesce("l.ready", F.lit(False)).alias("ready"))


def versions(syncs: DataFrame) -> DataFrame:
    """seq, path, version and sent: a document's version rises when its hash differs from the one before."""
    w = Window.partitionBy("path").orderBy("ts", "seq")
    new = F.lag("hash").over(w).isNull() | (F.lag("hash").over(w) != F.col("hash"))
    s = syncs.withColumn("sent", new)
    return s.withColumn("version", F.sum(F.col("sent").cast("int")).over(w)).select("seq", "path", "version", "sent")


def backoff(failures):
    """Seconds before the next start: 1, 2, 4 and so on up to 60."""
    return F.least(F.pow(F.lit(2.0), failures), F.lit(60.0))


def index_loop(stream: DataFrame, drain, checkpoint: str):
    """Runs `drain(batch)` for each micro-batch until the source has no more."""
    return stream.writeStream.foreachBatch(lambda df, _: drain(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
