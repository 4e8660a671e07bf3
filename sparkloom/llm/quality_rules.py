"""Operator 3: quality rules with thresholds from mergeable quantile sketches.

Each rule watches a measure that junk raises: the shares of symbols, capitals,
digits, words that repeat the one before, and lines that repeat another, and
the mean length of words.  The measures are built-in expressions, taken in one pass over the
texts and kept as a narrow table.  KLL sketches of each measure are made for every
language and source and merged, never recomputed, for every language and for
the whole; a group of fewer than `MIN_GROUP` documents borrows the thresholds of
its language, a small language those of the whole.  The threshold is

    median + SPREAD * max(median - 10 % quantile, the measure's resolution)

which stays put until half of a group is junk.  Documents are filtered by a join
with the thresholds of their group.  Sketches of up to `SKETCH_K` values are
exact; above, ranks are off by about 1/SKETCH_K.

Nulls: null languages and sources form groups of their own; a null id is kept as it is.
A null or empty text, or one without a word, breaks the rule `words`.  Very long texts
are measured whole.  Repeated rows count, and are judged, once for each row.  Ties: a
measure equal to its threshold keeps to the rule.  An empty table gives an empty result;
further columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import take, written

SKETCH_K, MIN_GROUP, SPREAD, PAD = 1024, 100, 6.0, 100
#: Measure: resolution.
RULES = {"symbols": 0.01, "capitals": 0.01, "digits": 0.01, "repeats": 0.02, "lines": 0.05, "word_length": 1.0}

_SYMBOLS = r"[#$%&*|!<>{}@=+~^\[\]\\]"
_CAPITALS = "[A-ZÀ-ÖØ-Þ]"


def measures(text: Column) -> dict[str, Column]:
    """The rules' measures; PAD draws those of short texts towards 0."""
    size = F.length(text) + F.lit(PAD)
    words = F.regexp_count(text, F.lit(r"[^ \n\t\r]+"))
    lines = F.split(text, "\n")
    number = F.size(lines)
    return {
        "n_words": words,
        "symbols": F.regexp_count(text, F.lit(_SYMBOLS)) / size,
        "capitals": F.regexp_count(text, F.lit(_CAPITALS)) / size,
        "digits": F.regexp_count(text, F.lit("[0-9]")) / size,
        "repeats": F.regexp_count(text, F.lit(r"(?<![^ \n\t\r])([^ \n\t\r]++)(?=[ \n\t\r]+\1(?![^ \n\t\r]))")) / (words + F.lit(20)),
        "lines": (number - F.size(F.array_distinct(lines))) / (number + F.lit(5)),
        "word_length": F.length(text) / (words + F.lit(1)),
    }


def _quantiles(sketches: DataFrame, keys: list[str], spread: float) -> DataFrame:
    out = [*keys, "n"]
    for r, least in RULES.items():
        q = lambda p, r=r: F.kll_sketch_get_quantile_double(F.col(r), F.lit(p))
        out.append((q(0.5) + spread * F.greatest(q(0.5) - q(0.1), F.lit(least))).alias(r))
    return sketches.select(*out)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP, spread: float = SPREAD, k: int = SKETCH_K) -> DataFrame:
    """doc_id, lang, source, `broken` (names of the rules, by comma) and kept, for every row."""
    d = take(docs, id_col, text_col, lang_col, source_col).toDF("doc_id", "text", "lang", "source")
    text = F.coalesce("text", F.lit(""))
    m = written(d.select("doc_id", "lang", "source", *[c.alias(n) for n, c in measures(text).items()]), "measures")
    some = m.filter("n_words > 0")
    fine = some.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(F.col(r).cast("double"), F.lit(k)).alias(r) for r in RULES])
    fine = written(fine, "sketches")
    total = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(r, F.lit(k)).alias(r) for r in RULES]]
    by_lang, whole = fine.groupBy("lang").agg(*total), fine.agg(*total).filter("n > 0")
    a = _quantiles(fine, ["lang", "source"], spread).alias("a")
    b = _quantiles(by_lang, ["lang"], spread).alias("b")
    c = _quantiles(whole, [], spread).alias("c")
    limit = [F.when(F.col("a.n") >= min_group, F.col(f"a.{r}")).when(F.col("b.n") >= min_group, F.col(f"b.{r}")).otherwise(F.col(f"c.{r}")).alias(r) for r in RULES]
    limits = written(a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang"))).crossJoin(c).select("a.lang", "a.source", *limit), "limits")
    x, y = m.alias("x"), limits.alias("y")
    both = x.join(y, F.col("x.lang").eqNullSafe(F.col("y.lang")) & F.col("x.source").eqNullSafe(F.col("y.source")), "left")
    broken = F.concat_ws(",", F.when(F.col("x.n_words") == 0, F.lit("words")), *[F.when((F.col("x.n_words") > 0) & (F.col(f"x.{r}") > F.col(f"y.{r}")), F.lit(r)) for r in RULES])
    return both.select("x.doc_id", "x.lang", "x.source", broken.alias("broken")).withColumn("kept", F.col("broken") == "")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that break no rule."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("kept").select("doc_id", "lang", "source")


_DUCK = "(quantile_disc({r}, 0.5) + 6.0 * greatest(quantile_disc({r}, 0.5) - quantile_disc({r}, 0.1), {least})) AS {r}"
_LIMITS = ", ".join(_DUCK.format(r=r, least=least) for r, least in RULES.items())
_CHOSEN = ", ".join(f"CASE WHEN a.n >= {MIN_GROUP} THEN a.{r} WHEN b.n >= {MIN_GROUP} THEN b.{r} ELSE c.{r} END AS {r}" for r in RULES)
_BROKEN = ", ".join(f"CASE WHEN m.n_words > 0 AND m.{r} > l.{r} THEN '{r}' END" for r in RULES)


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))"


SQL3 = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ \n\t\r]+') AS w, string_split(t, chr(10)) AS ln FROM d),
m AS (SELECT doc_id, lang, source, len(w) AS n_words,
  {_count(_SYMBOLS)} / (length(t) + {PAD}) AS symbols,
  {_count(_CAPITALS)} / (length(t) + {PAD}) AS capitals,
  {_count('[0-9]')} / (length(t) + {PAD}) AS digits,
  len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) / (len(w) + 20) AS repeats,
  (len(ln) - len(list_distinct(ln))) / (len(ln) + 5) AS lines,
  length(t) / (len(w) + 1) AS word_length FROM w),
s AS (SELECT * FROM m WHERE n_words > 0),
a AS (SELECT lang, source, count(*) AS n, {_LIMITS} FROM s GROUP BY lang, source),
b AS (SELECT lang, count(*) AS n, {_LIMITS} FROM s GROUP BY lang),
c AS (SELECT {_LIMITS} FROM s),
l AS (SELECT a.lang, a.source, {_CHOSEN} FROM a JOIN b ON a.lang IS NOT DISTINCT FROM b.lang CROSS JOIN c),
r AS (SELECT m.doc_id, m.lang, m.source, concat_ws(',', CASE WHEN m.n_words = 0 THEN 'words' END, {_BROKEN}) AS broken
  FROM m LEFT JOIN l ON m.lang IS NOT DISTINCT FROM l.lang AND m.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, lang, source FROM r WHERE broken = ''
"""
