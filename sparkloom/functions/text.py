"""Scalar text expressions; JVM-side columns but for the count of trigrams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spaced(text: Column) -> Column:
    """Camel-case boundaries turned into spaces."""
    return F.regexp_replace(text, r"(\p{Ll}|\p{N})(\p{Lu})", "$1 $2")


def tokens(text: Column) -> Column:
    """Lower-cased words, split at non-alphanumerics and camel-case boundaries; words that were split also whole.

    A text without a boundary, such as most prose, is only split.
    """
    boundary = r"(?:\p{Ll}|\p{N})\p{Lu}"
    parts = F.split(F.lower(spaced(text)), r"[^\p{L}\p{N}]+")
    whole = F.transform(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w.rlike(boundary)), F.lower)
    return F.filter(F.when(text.rlike(boundary), F.concat(parts, whole)).otherwise(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: w != "")


def token_count(text: Column) -> Column:
    """The number of `tokens`, counted without making them: words, boundaries inside words, and words that have one."""
    boundary = r"(?:\p{Ll}|\p{N})\p{Lu}"
    whole = r"[\p{L}\p{N}]*" + boundary + r"[\p{L}\p{N}]*"
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+")) + F.when(text.rlike(boundary), F.regexp_count(text, F.lit(boundary)) + F.regexp_count(text, F.lit(whole))).otherwise(0)


def query_tokens(query: str) -> list[str]:
    """`tokens` of a literal, on the driver, in order and once each."""
    alnum = re.compile(r"[^\W_]+")
    out = []
    for w in alnum.findall(query):
        pieces, start = [], 0
        for k in range(1, len(w)):
            if w[k].isupper() and (w[k - 1].islower() or w[k - 1].isnumeric()):
                pieces.append(w[start:k])
                start = k
        pieces.append(w[start:])
        out += [p.lower() for p in pieces] + ([w.lower()] if len(pieces) > 1 else [])
    return list(dict.fromkeys(out))


def trigrams(text: Column) -> Column:
    """The set of 3-character substrings of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def query_trigrams(query: str) -> list[str]:
    q = query.lower()
    return list(dict.fromkeys(q[k : k + 3] for k in range(len(q) - 2)))


def distinct_trigrams(texts: list[str], width: int = 1 << 20) -> np.ndarray:
    """The number of distinct 3-character substrings of each text.

    Characters are numbered within a group of texts of about `width` characters, so that
    a text's number and three characters fit in 64 bits, which are then sorted.
    """
    out = np.zeros(len(texts), np.int32)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= width) and hi - lo < 1 << 15:
            size += len(texts[hi])
            hi += 1
        lengths = np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo)
        points = np.frombuffer("".join(texts[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32)
        number = np.zeros(int(points.max(initial=0)) + 1, np.uint64)  # of each character; a table, as a sort takes far longer
        number[points] = 1
        bits = max(1, (int(number.sum()) - 1).bit_length())
        code = (np.cumsum(number) - number)[points]
        row = np.repeat(np.arange(hi - lo, dtype=np.uint64), lengths)
        if len(code) > 2:
            inside = row[2:] == row[:-2]
            shift = np.uint64(bits)
            if 3 * bits + 15 <= 64:
                gram = (((row[2:] << shift | code[:-2]) << shift | code[1:-1]) << shift | code[2:])[inside]
                gram.sort()
                new = gram[np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])] if len(gram) else gram
                out[lo:hi] = np.bincount((new >> np.uint64(3 * bits)).astype(np.int64), minlength=hi - lo)
            else:
                for k in range(lo, hi):
                    out[k] = len({texts[k][i : i + 3] for i in range(len(texts[k]) - 2)})
        lo = hi
    return out


def trigram_count(low: Column) -> Column:
    """The size of `trigrams` of a lower-cased text; 0 for null."""

    @F.arrow_udf("int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(distinct_trigrams(["" if t is None else t for t in texts.to_pylist()]), pa.int32())

    return run(low)


def shared_trigrams(low: Column, query: str) -> Column:
    """How many of the query's trigrams a lower-cased text holds: a sum of `contains`, as they are literals."""
    return sum((F.coalesce(F.contains(low, F.lit(g)).cast("int"), F.lit(0)) for g in query_trigrams(query)), F.lit(0))


def leaf(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def with_fuzzy(df: DataFrame, text: Column, query: str, name: str) -> DataFrame:
    """Adds the greedy leftmost subsequence score: 10 a match, 15 more where it follows the last, 10 more at the start or after a non-alphanumeric; null if incomplete.

    The walk folds the query's characters over (place, score).  A fold keeps the
    expression as long as the query, where columns that build on one another
    would double with each character once a filter is pushed through them.
    """
    if not query:
        return df.withColumn(name, F.lit(0))
    low = F.lower(text)

    def step(acc: Column, c: Column) -> Column:
        def found(h: Column) -> Column:
            edge = (h == 1) | ~F.substring(low, h - 1, F.lit(1)).rlike(r"[\p{L}\p{N}]")
            more = F.when((acc["at"] > 0) & (h == acc["at"] + 1), 15).otherwise(0) + F.when(edge, 10).otherwise(0)
            return F.struct(h.alias("at"), (acc["score"] + 10 + more).alias("score"))

        place = F.when(acc["at"].isNotNull(), F.nullif(F.call_function("locate", c, low, acc["at"] + 1), F.lit(0)))
        return F.element_at(F.transform(F.array(place), found), 1)

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("score"))
    return df.withColumn(name, F.aggregate(F.array(*map(F.lit, query.lower())), start, step, lambda acc: F.when(acc["at"].isNotNull(), acc["score"])))


def safe_path(path: Column) -> Column:
    """Relative, not under a home folder, and without a parent step."""
    return ~path.rlike(r"^[/~]") & ~F.array_contains(F.split(path, "/"), "..")


def glob_regex(glob: str) -> str:
    """A regular expression for a shell pattern whose `*` and `?` also cross slashes."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if c == "[" and (end := glob.find("]", k + 2)) > 0:
            body = glob[k + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            k = end
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(c, re.escape(c))
        k += 1
    return f"^{out}$"
