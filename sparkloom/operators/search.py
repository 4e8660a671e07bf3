"""Hybrid search: BM25, trigram Dice and cosine, fused by reciprocal ranks.

A query is a literal, so term frequencies are counted inside each row and the
only shuffles are a one-row aggregate of corpus statistics and the ranking of
the rows that scored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import with_rank
from ..functions.text import query_tokens, query_trigrams, shared_trigrams, token_count, tokens, trigram_count
from ..plans.session import shared


@dataclass(frozen=True)
class Weights:
    bm25: float = 1.0
    trigram: float = 1.0
    cosine: float = 1.0


K1, B, RRF_K, SYMBOL_WEIGHT = 1.2, 0.75, 60, 5


def bm25(chunks: DataFrame, query: str) -> DataFrame:
    """chunk_id and score (`bm25`) of the chunks with a score above 0; a term counts five times in the symbol path."""
    terms = query_tokens(query)
    if not terms:
        return chunks.select("chunk_id", F.lit(0.0).alias("bm25")).limit(0)
    # words are only made where a term occurs at all; the length is counted without them
    count = lambda text, term: F.when(F.contains(F.lower(text), F.lit(term)), F.size(F.filter(tokens(text), lambda w: w == term))).otherwise(0)
    body, path = F.coalesce("text", F.lit("")), F.coalesce("symbol_path", F.lit(""))
    t = chunks.select("chunk_id", (token_count(body) + token_count(path)).alias("_n"), *[(count(body, q) + SYMBOL_WEIGHT * count(path, q)).alias(f"_f{k}") for k, q in enumerate(terms)])
    t = shared(t, "terms")  # the statistics and the scores read it; texts are gone through once
    stats = t.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_mean"), *[F.count_if(F.col(f"_f{k}") > 0).alias(f"_d{k}") for k in range(len(terms))])
    idf = lambda k: F.log(1 + (F.col("_docs") - F.col(f"_d{k}") + 0.5) / (F.col(f"_d{k}") + 0.5))
    score = F.lit(0.0)
    for k in range(len(terms)):
        f = F.col(f"_f{k}")
        score = score + idf(k) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.col("_mean")))
    some = t.filter(" OR ".join(f"_f{k} > 0" for k in range(len(terms))))
    return some.crossJoin(F.broadcast(stats)).select("chunk_id", score.alias("bm25"))


def trigram(chunks: DataFrame, query: str) -> DataFrame:
    """chunk_id and `trigram` of the chunks with a score above 0: the Dice coefficient 2 |A and B| / (|A| + |B|) of the trigram sets, that of the symbol path five times.

    The trigrams of a chunk are only counted where one of the query's occurs in it.
    """
    n = len(query_trigrams(query))
    low = chunks.select("chunk_id", F.lower("text").alias("_t"), F.lower("symbol_path").alias("_s"))
    if not n:
        return low.select("chunk_id", F.lit(0.0).alias("trigram")).limit(0)
    # a generator, as a filter moves below columns and then works them out, lower-cased texts included, for each trigram
    found = F.struct(shared_trigrams(F.col("_t"), query).alias("_ft"), shared_trigrams(F.col("_s"), query).alias("_fs"))
    both = low.select("chunk_id", "_t", "_s", F.inline(F.array(found))).filter("_ft + _fs > 0")
    dice = lambda f, text: 2.0 * F.col(f) / (trigram_count(F.when(F.col(f) > 0, F.col(text))) + F.lit(n))
    return both.select("chunk_id", (SYMBOL_WEIGHT * dice("_fs", "_s") + dice("_ft", "_t")).alias("trigram"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(embedded: DataFrame, query: DataFrame) -> DataFrame:
    """chunk_id and `cosine` of every embedded chunk, also of 0 or less.

    `query` is one row with a column `q`.  The corpus has the dimension of its
    first embedded chunk; other rows aren't embedded.  A query of another
    dimension scores 0 everywhere.
    """
    dims = embedded.agg(F.min_by(F.size("embedding"), "chunk_id").alias("_dims"))
    e = embedded.crossJoin(F.broadcast(dims)).filter(F.size("embedding") == F.col("_dims")).crossJoin(F.broadcast(query.select("q")))
    return e.select("chunk_id", F.when(F.size("q") == F.col("_dims"), dot(F.col("embedding"), F.col("q"))).otherwise(F.lit(0.0)).alias("cosine"))


def fuse(signals: dict[str, DataFrame], weights: Weights) -> DataFrame:
    """chunk_id, score and the signals: weighted reciprocal ranks over the best that the taking-part signals allow.

    Signals of weight 0 or without a row don't take part.
    """
    lists = []
    for name, df in signals.items():
        w = getattr(weights, name)
        if w > 0:
            r = with_rank(df.withColumn("_key", F.round(name, 9)), "_rank", F.desc("_key"), F.asc("chunk_id"))
            parts = {n: (F.col(n) if n == name else F.lit(0.0)).alias(n) for n in signals}
            lists.append(r.select("chunk_id", (w / (RRF_K + F.col("_rank"))).alias("_share"), *parts.values(), F.lit(name).alias("_signal"), F.lit(float(w)).alias("_w")))
    if not lists:
        first = next(iter(signals.values()))
        return first.select("chunk_id", F.lit(0.0).alias("score"), *[F.lit(0.0).alias(n) for n in signals]).limit(0)
    both = lists[0]
    for x in lists[1:]:
        both = both.unionByName(x)
    ceiling = both.groupBy("_signal").agg(F.max("_w").alias("_w")).agg((F.sum("_w") / (RRF_K + 1)).alias("_top"))
    total = both.groupBy("chunk_id").agg(F.sum("_share").alias("_sum"), *[F.max(n).alias(f"_hi_{n}") for n in signals], *[F.min(n).alias(f"_lo_{n}") for n in signals])
    value = lambda n: F.when(F.col(f"_hi_{n}") > 0, F.col(f"_hi_{n}")).otherwise(F.col(f"_lo_{n}"))
    return total.crossJoin(F.broadcast(ceiling)).select("chunk_id", (F.col("_sum") / F.col("_top")).alias("score"), *[value(n).alias(n) for n in signals])


def hybrid(chunks: DataFrame, embedded: DataFrame, query: str, vector: DataFrame, top_k: int = 20, weights: Weights = Weights()) -> DataFrame:
    """The best chunks with their signals, path, symbol, kind, line and text."""
    signals = {"bm25": bm25(chunks, query), "trigram": trigram(chunks, query), "cosine": cosine(embedded, vector)}
    signals = {name: shared(df, name) for name, df in signals.items()}  # ranks and the ceiling read each several times
    best = fuse(signals, weights).orderBy(F.desc(F.round("score", 9)), "chunk_id").limit(top_k)
    return chunks.join(F.broadcast(best), "chunk_id").select("chunk_id", "score", "bm25", "trigram", "cosine", "file_path", "symbol_path", "kind", "start_line", "text")


def progress(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """total, embedded and whether a note about unfinished work is due."""
    have = chunks.join(embedded.select("chunk_id").distinct().withColumn("_e", F.lit(1)), "chunk_id", "left")
    return have.agg(F.count("*").alias("total"), F.count("_e").alias("embedded")).withColumn("note", (F.col("total") == 0) | (F.col("embedded") < F.col("total")))


def postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, tf and length: the inverted index, for corpora that many queries share.

    Chunks are shuffled by their id as they are, and words are made and counted where they come to lie.
    The number of partitions is given, as texts become many times their size in postings.
    """
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = chunks.select("chunk_id", "text", "symbol_path").repartition(n, "chunk_id").select("chunk_id", tokens(F.col("text")).alias("b"), tokens(F.col("symbol_path")).alias("s"))
    both = F.concat(F.coalesce("b", F.array().cast("array<string>")), F.coalesce("s", F.array().cast("array<string>")))
    each = t.select("chunk_id", (F.size("b") + F.size("s")).alias("length"), F.coalesce(F.size("b"), F.lit(0)).alias("_n"), F.posexplode(both).alias("_k", "term"))
    return each.groupBy("term", "chunk_id", "length").agg(F.sum(F.when(F.col("_k") < F.col("_n"), 1).otherwise(SYMBOL_WEIGHT)).alias("tf")).select("term", "chunk_id", "tf", "length")


def document_frequency(chunks: DataFrame) -> DataFrame:
    """term and df over all chunks; terms are made distinct inside each row before any shuffle."""
    t = chunks.select(F.explode(F.array_distinct(F.concat(tokens(F.col("text")), tokens(F.col("symbol_path"))))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df"))
