"""Operator 4: personal data by pattern, checksum and context.

Regular expressions propose spans: e-mail addresses, telephone numbers, payment
cards, IBANs, US social security numbers, Spanish and French national numbers, IPv4
addresses.  A validator confirms or refutes each: Luhn for cards, mod 97 with the
country's length for IBANs, mod 97 and mod 23 for the national numbers, assignment rules for
the others.  A telephone number after + may be grouped in any way; one without + that
no other form confirms, bare or of few groups, has a low score.  Words near the span that name its kind (in English, French, German
and Spanish) raise the score.  Spans of a score of at least `LEAST` are
reported; of overlapping ones the best, then the longest, then the first.

Rows in which no pattern could match never leave the JVM.  Nulls: a null or
empty text has none; a null id is reported as it is.  Repeated rows are reported once
for each row.  Texts are scanned whole, however long.  An empty table gives an empty
result; further columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import take

LEAST, NEAR = 0.5, 48
#: Every pattern's match holds a match of this.
PREFILTER = r"[A-Za-z0-9._%+\-]@[A-Za-z0-9\-]|[0-9][0-9 ()./\-]{4,}[0-9]|[A-Za-z]{2}[0-9]{2} ?[A-Za-z0-9]{4}|[0-9XYZxyz][0-9]{6,7}-?[A-Za-z]"

_IBAN_LENGTH = {k: int(n) for k, n in re.findall(r"([A-Z]{2})(\d\d)", "AD24 AE23 AT20 BE16 BG22 CH21 CY28 CZ24 DE22 DK18 EE20 ES24 FI18 FR27 GB22 GR27 HR21 HU28 IE22 IL23 IS26 IT27 LI21 LT20 LU20 LV21 MC27 MT31 NL18 NO15 PL28 PT25 RO24 SA24 SE24 SI19 SK24 SM27 TR26")}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(s: str) -> bool:
    if len(s) != _IBAN_LENGTH.get(s[:2], -1):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _email(m: re.Match) -> tuple[float, bool | None]:
    local, domain = m[0].rsplit("@", 1)
    ok = len(domain.rsplit(".", 1)[1]) >= 2 and ".." not in m[0] and domain.rsplit(".", 1)[1].isalpha()
    return (0.9 if ok else 0.2), None


def _phone(m: re.Match) -> tuple[float, bool | None]:
    n = sum(c.isdigit() for c in m[0])
    if not 7 <= n <= 15:
        return 0.0, None
    if m[0][0] == "+":
        return 0.75, None
    if "(" in m[0] or re.fullmatch(r"\d{3}[ .\-]\d{3}[ .\-]\d{4}", m[0]):
        return 0.55, None
    return 0.3, None


def _local(m: re.Match) -> tuple[float, bool | None]:
    return min(0.3, _phone(m)[0]), None


def _card(m: re.Match) -> tuple[float, bool | None]:
    d = re.sub(r"\D", "", m[0])
    if not luhn(d) or len(set(d)) < 2:
        return 0.1, False
    return (0.9 if re.match(r"4|5[1-5]|2[2-7]|3[4-7]|6(?:011|5|4)", d) else 0.6), True


_CARD_START = re.compile(r"(?<![\w.])\d(?=(?:[ \-]?\d){12})")
_CARD_LENGTHS = [re.compile(rf"\d(?:[ \-]?\d){{{n - 1}}}(?!\w)") for n in range(19, 12, -1)]


def _cards(text: str) -> Iterator[re.Match]:
    """At each start the longest of 13 to 19 digits, ending with a group, that passes Luhn, or the longest at all; goes on behind a card of a known issuer, else at the next start."""
    at = 0
    while start := _CARD_START.search(text, at):
        at, longest = start.end(), None
        for p in _CARD_LENGTHS:
            if m := p.match(text, start.start()):
                longest = longest or m
                score, ok = _card(m)
                if ok:
                    longest, at = m, m.end() if score > 0.6 else at
                    break
        if longest:
            yield longest


_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}(?=\d{2} ?[A-Za-z0-9]{4})")
_IBAN_FORMS = {n: re.compile(rf"[A-Za-z]{{2}}\d{{2}}(?: ?[A-Za-z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Za-z0-9]{{{n % 4}}}" if n % 4 else "") + r"(?![A-Za-z0-9])") for n in set(_IBAN_LENGTH.values())}


def _ibans(text: str) -> Iterator[re.Match]:
    """What begins like an IBAN and has its country's length, whatever words follow."""
    at = 0
    while start := _IBAN_START.search(text, at):
        at = start.end()
        form = _IBAN_FORMS.get(_IBAN_LENGTH.get(start[0].upper(), 0))
        if form and (m := form.match(text, start.start())):
            yield m


def _iban(m: re.Match) -> tuple[float, bool | None]:
    ok = iban(m[0].replace(" ", "").upper())
    return (0.95 if ok else 0.1), ok


def _ssn(m: re.Match) -> tuple[float, bool | None]:
    a, b, c = m[0].split("-")
    ok = a not in ("000", "666") and a < "900" and b != "00" and c != "0000"
    return (0.55 if ok else 0.1), ok


def _dni(m: re.Match) -> tuple[float, bool | None]:
    s = m[0].upper().replace("-", "")
    ok = "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == s[-1]
    return (0.6 if ok else 0.05), ok


def _nir(m: re.Match) -> tuple[float, bool | None]:
    d = m[0].replace(" ", "")
    ok = (97 - int(d[:13]) % 97) == int(d[13:]) and 1 <= int(d[3:5]) <= 12
    return (0.85 if ok else 0.05), ok


def _ip(m: re.Match) -> tuple[float, bool | None]:
    p = [int(x) for x in m[0].split(".")]
    if max(p) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
        return 0.0, False
    private = p[0] in (0, 10, 127) or p[0] >= 224 or p[:2] == [192, 168] or (p[0] == 172 and 16 <= p[1] < 32) or max(p) < 20
    return (0.2 if private else 0.55), not private


_PHONE_WORDS = r"phone|\bcall(?:s|ed|ing|me|us)?\b|\btel\b|\bmobil|\bcell(?:ular)?\b|\bfax|telefon|\banruf|\bruf|\bhandy|téléphone|\bportable\b|\bappel|teléfono|\bmóvil|\bllam"
_KINDS = [
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}(?![A-Za-z0-9\-])", _email, r"mail|contact|kontakt|contacto|correo|courriel|adresse|reach|write"),
    ("phone", r"(?<![\w.+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]\d{2,4}){1,4}(?![\w]|[.\-]\d)", _phone, _PHONE_WORDS),
    ("phone", r"(?<![\w.+])\+\d(?:(?:[ .\-/]?\(|\)[ .\-/]?|[ .\-/])?\d){5,13}\d(?!\w|[.\-]\d)", _phone, _PHONE_WORDS),
    ("phone", r"(?<![\w.+])(?<!\d[\-/])(?:\d{7,15}|(?:\(\d{2,6}\)[ .\-/]?|\d{2,6}[ .\-/])\d{2,10}(?:[ .\-/]\d{2,10}){0,3})(?!\w|[.\-/]\d)", _local, _PHONE_WORDS),
    ("card", _cards, _card, r"cards?\b|\bvisa\b|\bamex|\bcredit|\bdebit|karte|\bcarte|\btarjeta|\bpayment|\bkredit"),
    ("iban", _ibans, _iban, r"iban|account|konto|compte|cuenta|bank|transfer|überweis|virement"),
    ("ssn", r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])", _ssn, r"\bssn|social security|taxpayer"),
    ("dni", r"(?<![A-Za-z0-9])(?:\d{8}|[XYZxyz]\d{7})-?[A-Za-z](?![A-Za-z0-9])", _dni, r"\bdni\b|\bnie\b|\bnif\b|documento|identidad"),
    ("nir", r"(?<!\d)[12] ?\d\d ?\d\d ?\d\d ?\d{3} ?\d{3} ?\d\d(?!\d)", _nir, r"sécu|sociale|nir\b|insee"),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _ip, r"\bip\b|address|host|server|adresse|dirección|login|logged"),
]
_KINDS = [(k, re.compile(p).finditer if isinstance(p, str) else p, f, re.compile(c, re.I)) for k, p, f, c in _KINDS]


def spans(text: str, least: float = LEAST) -> list[tuple[int, int, str, float, bool | None, bool]]:
    """(start, end, kind, score, checksum, context), by start."""
    got = []
    for kind, propose, judge, words in _KINDS:
        for m in propose(text):
            score, checked = judge(m)
            near = bool(words.search(text, max(0, m.start() - NEAR), m.start()) or words.search(text, m.end(), m.end() + NEAR // 2))
            score = round(min(1.0, score + 0.25 * near * (checked is not False)), 2)
            if score >= least:
                got.append((m.start(), m.end(), kind, score, checked, near))
    got.sort(key=lambda x: (-x[3], x[0] - x[1], x[0]))
    out: list[tuple] = []  # by start, none overlapping another
    for x in got:
        k = bisect_left(out, x[:2])
        if (not k or out[k - 1][1] <= x[0]) and (k == len(out) or x[1] <= out[k][0]):
            out.insert(k, x)
    return out


_FIELDS = ("start", "end", "kind", "score", "checksum", "context")


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row for each span: doc_id, start and end (characters), kind, score, checksum (null where the kind has none), context."""
    d = take(docs, id_col, text_col).toDF("doc_id", "text").filter(F.col("text").rlike("[0-9@]") & F.col("text").rlike(PREFILTER))

    @F.arrow_udf("array<struct<start:int,end:int,kind:string,score:double,checksum:boolean,context:boolean>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64()), ("checksum", pa.bool_()), ("context", pa.bool_())]))
        for texts in batches:
            yield pa.array([[dict(zip(_FIELDS, x)) for x in spans(t or "", least)] for t in texts.to_pylist()], kind)

    return d.select("doc_id", F.explode(run("text")).alias("s")).select("doc_id", "s.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
