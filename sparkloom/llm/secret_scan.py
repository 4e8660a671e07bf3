"""Operator 1: secrets by token efficiency.

Ordinary text takes few tokens a character; random strings take many.  A
*candidate* is a run of at least `MIN_RUN` characters of the alphabets of keys
that holds a letter, a value of at least `MIN_VALUE` characters that is assigned
to a name such as password, token or api_key, or a JSON web token (dotted segments
of base64url, the first an object).  Its characters per token under the vocabulary
tell: under `RATIO` (or `RATIO_ASSIGNED` for an assigned value and a JSON web token,
where the name or form is evidence too) it is a secret, unless it is

* a digest: hexadecimal of the length of a known hash, alone or after a word
  such as commit, sha256 or checksum (but not as a value of a secret's name);
* an identifier: a UUID not given to a secret's name; a path; what follows a . or =
  in a URL, domain or query, but for the value of a secret's name; words, numbers and
  camel-case parts joined by _ - . or /; a number.  Camel case of letters alone is
  left to the characters per token: random letters often read as short words.

A word in capitals counts the tokens of its small letters, if these are fewer, and
is none amid text in capitals.  Runs
that are found and joined by dots, such as keys of two parts, are one secret.

The vocabulary is read on the driver and broadcast as bytes (under 1 MB).  Rows
without any candidate never leave the JVM.

Nulls: a null or empty text has no secret; a null id is reported as it is.  Repeated
rows are reported once for each row.  Texts are scanned whole; a run may have any
length.  There are no ties: secrets are reported by their start and don't overlap; where
an assigned value and a run overlap, the value counts.  An empty table gives an empty
result; further columns, whatever their names, are left out by `secrets` and kept as
they are by `mask_secrets`.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, take

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MIN_RUN, MIN_VALUE, RATIO, RATIO_ASSIGNED = 16, 8, 2.2, 2.8
MASK = "[SECRET]"

#: What \s is in Python; Java's is less.
_SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Every candidate holds a match of this, also in Java: the form of `_RUN` at its shortest, or that of `_VALUE`.
PREFILTER = rf"[A-Za-z0-9+/_\-]{{16}}|[:=][{_SPACE}]{{0,3}}(?:[Bb]earer[{_SPACE}])?[\"'`]?[^\s\"'`,;<>]{{8}}"
_RUN = re.compile(rf"[A-Za-z0-9+/_\-]{{{MIN_RUN},}}={{0,2}}")
_VALUE = re.compile(rf"[:=]\s{{0,3}}(?:[Bb]earer\s)?[\"'`]?([^\s\"'`,;<>]{{{MIN_VALUE},}})")
_NAME = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|bearer|(?<![a-z])(?:auth|(?:[a-z0-9]{1,20}[_\-]?)?key))[\"']?\s{0,3}:?$")
_DIGEST_WORD = re.compile(r"(?i)(?:sha-?(?:1|224|256|384|512)?|md5|commit|checksum|digest|hash|etag|revision|rev|integrity|fingerprint|blake2b?|crc32)[\"']?\s{0,2}[:=\s#-]\s{0,3}[\"']?$")
_JWT = re.compile(r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{13,}+(?:\.[A-Za-z0-9_\-]*+){1,4}(?<!\.)")
_URL = re.compile(r"://[^\s\"'<>`]+|(?<![\w.\-])(?:[A-Za-z0-9\-]{1,63}\.){1,8}(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|app|dev|cloud|online|site|shop|tech|xyz|blog|page|local|internal)(?![\w\-])(?::\d{1,5})?(?:[/?#][^\s\"'<>`]*)?")
_QUERY = re.compile(r"[?&][\w.%\-\[\]]{1,64}=$")
_NUMBER = re.compile(r"\d+(?:[_\-]\d+)*(?:[eE][+\-]?\d+)?[A-Za-z]{0,3}")
_BETWEEN = re.compile(r"\.(?:[A-Za-z0-9_\-]+\.)?")
_HEX = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_PART = re.compile(r"([A-Za-z]*)(\d{0,8})")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LENGTHS = {32, 40, 56, 64, 96, 128}


@lru_cache(4)
def _encoder(raw: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _identifier(s: str) -> bool:
    """Whether the string reads as camel-case words of at least 3 letters on average, none of an unlikely length, with numbers only at the ends of parts."""
    words: list[str] = []
    for part in re.split(r"[_\-./+=]+", s):
        m = _PART.fullmatch(part)
        if not m:
            return False
        words += _WORD.findall(m[1])
    return not words or sum(map(len, words)) / len(words) >= 3 and max(len(w) - 10 * w.islower() for w in words) <= 12


def _free(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a to b overlaps none of the ascending spans, which don't overlap one another."""
    k = bisect(spans, (b, -1)) - 1
    return k < 0 or spans[k][1] <= a


def scan(text: str, encode, ratio: float = RATIO, ratio_assigned: float = RATIO_ASSIGNED) -> list[tuple[int, int, str, int, float]]:
    """(start, end, kind, tokens, characters per token) of the secrets, by start and without overlap."""
    found: list[tuple[int, int, str, int, float]] = []
    taken = []
    for m in _VALUE.finditer(text):
        if not _NAME.search(text, max(0, m.start() - 48), m.start()):
            continue
        a, b = m.span(1)
        while b > a and text[b - 1] in ".!?)]}*$&%#|":
            b -= 1
        value = text[a:b]
        if len(value) < MIN_VALUE or "://" in value or value.isalpha() and len(value) < MIN_RUN:
            continue
        n = len(encode(value))
        taken.append((a, b))
        if n and len(value) / n < ratio_assigned and not (value.isdigit() and len(value) < 12):
            found.append((a, b, "assigned", n, len(value) / n))
    for m in _JWT.finditer(text):
        a, b = m.span()
        if not _free(taken, a, b):
            continue
        n = len(encode(m[0]))
        if (b - a) / n < ratio_assigned:
            insort(taken, (a, b))
            found.append((a, b, "run", n, (b - a) / n))
    urls = None
    runs: list[tuple[int, int, int]] = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        value = m[0]
        if not _free(taken, a, b):
            continue
        if not any(c.isalpha() for c in value):
            continue
        if _HEX.fullmatch(value) and len(value) in _LENGTHS or _UUID.fullmatch(value) or _DIGEST_WORD.search(text[max(0, a - 40) : a]):
            continue
        letters = value.isalpha()
        if _identifier(value.lower() if letters and value.istitle() else value) and not (letters and len(_WORD.findall(value)) > 1):
            continue
        n = len(encode(value))
        if letters and value.isupper():
            around = [c for c in text[max(0, a - 12) : a] + text[b : b + 12] if c.isalpha()]
            if len(around) >= 4 and all(c.isupper() for c in around):
                continue
            n = min(n, len(encode(value.lower())))
        if len(value) / n >= ratio:
            continue
        if a and text[a - 1] in "=.":
            if _NUMBER.fullmatch(value):
                continue
            if not _NAME.search(text, max(0, a - 49), a - 1):
                urls = [u.span() for u in _URL.finditer(text)] if urls is None else urls
                at = bisect(urls, (a, -1)) - 1
                if at >= 0 and a < urls[at][1] or _QUERY.search(text[max(0, a - 66) : a]):
                    continue
        if runs and _BETWEEN.fullmatch(text, runs[-1][1], a):
            a = runs.pop()[0]
            n = len(encode(text[a:b]))
        runs.append((a, b, n))
    found += [(a, b, "run", n, (b - a) / n) for a, b, n in runs]
    return sorted(found)


def mask(text: str, found: list[tuple]) -> str:
    parts, at = [], 0
    for a, b, *_ in found:
        if a >= at:
            parts += [text[at:a], MASK]
            at = b
    return "".join([*parts, text[at:]])


def _vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _possible(text: Column) -> Column:
    return text.rlike(PREFILTER)


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each secret: doc_id, start and end (characters), kind, n_tokens and chars_per_token.  The secret itself isn't repeated."""
    raw = _vocabulary(docs.sparkSession, vocabulary)
    d = take(docs, id_col, text_col).toDF("doc_id", "text").filter(_possible(F.col("text")))

    @F.arrow_udf("array<struct<start:int,end:int,kind:string,n_tokens:int,chars_per_token:double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("n_tokens", pa.int32()), ("chars_per_token", pa.float64())]))
        encode = _encoder(raw.value)
        for texts in batches:
            yield pa.array([[dict(zip(("start", "end", "kind", "n_tokens", "chars_per_token"), x)) for x in scan(t or "", encode)] for t in texts.to_pylist()], kind)

    return d.select("doc_id", F.explode(run("text")).alias("s")).select("doc_id", "s.*")


def masked(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The text with every secret replaced."""
    raw = _vocabulary(spark, vocabulary)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = _encoder(raw.value)
        for texts in batches:
            yield pa.array([None if t is None else mask(t, scan(t, encode)) for t in texts.to_pylist()], pa.string())

    return run(text)


def mask_secrets(docs: DataFrame, *, text_col: str = "text", size_col: str = "n_chars", vocabulary: str = VOCABULARY) -> DataFrame:
    """`docs` with secrets masked in the text; the count of characters, where there is one, follows."""
    table, names = flat(docs)
    t = f"c{names.index(text_col)}"
    table = table.withColumn("new", F.coalesce(masked(docs.sparkSession, F.when(_possible(F.col(t)), F.col(t)), vocabulary), F.col(t)))
    if size_col in names:
        n = f"c{names.index(size_col)}"
        table = table.withColumn(n, F.when(F.col("new") != F.col(t), F.length("new").cast(table.schema[n].dataType)).otherwise(F.col(n)))
    return table.withColumn(t, F.col("new")).drop("new").toDF(*names)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
