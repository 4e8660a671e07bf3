import base64

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import bpe
from sparkloom.llm import textkit as tk


@pytest.fixture(scope="module")
def raw():
    with open(bpe.VOCABULARY, "rb") as f:
        return f.read()


_both = {}


def both(raw):
    if not _both:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _both["x"] = bpe.Codec(raw), tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _both["x"]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab ", max_size=200), st.text("aé漢0 '\n", max_size=60)))
def test_same_ids_and_round_trip(raw, text):
    codec, reference = both(raw)
    ids = codec.encode(text).tolist()
    assert ids == reference.encode_ordinary(text) and codec.decode(ids) == text


def lists(codec, texts):
    ids, n, exact = codec.encode_all(pa.array(texts, pa.string()))
    cut = np.r_[0, np.cumsum(n)].tolist()
    assert exact.all()
    return [ids[i:j].tolist() for i, j in zip(cut, cut[1:])]


ALPHABET = "a's dtllvere \n\tBé漢9٣\u00a0\u3000\u2003!-\u0308😀\x1c\x85\u200b"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(ALPHABET, max_size=30), st.text("aab", max_size=60)), max_size=12))
def test_many_texts_at_once(raw, texts):
    codec, reference = both(raw)
    assert lists(codec, texts) == [reference.encode_ordinary(t) for t in texts]
    data, offsets = tk.buffers(pa.array(texts, pa.string()))
    at = bpe.starts(data, offsets).tolist()
    assert [data[i:j].tobytes().decode() for i, j in zip(at, [*at[1:], len(data)])] == [p for t in texts for p in codec.split(t)]


def test_every_space_letter_and_number(raw):
    codec, reference = both(raw)
    texts = [f"a{c}b{c}{c}1{c} {c}" for c in map(chr, range(1, 0x3100))]
    assert lists(codec, texts) == [reference.encode_ordinary(t) for t in texts]


def test_pre_tokens_of_one_hash(raw, monkeypatch):
    codec, reference = bpe.Codec(raw), both(raw)[1]
    monkeypatch.setattr(tk, "hash_spans", lambda data, a, b: ((b - a) % 3).astype(np.uint64))
    texts = ["one two three fourth", "", "qqzzy unlikely wwords", "abcab" * 50]
    assert lists(codec, texts) == [reference.encode_ordinary(t) for t in texts]


def test_known_ones_are_forgotten_and_met_anew(raw, monkeypatch):
    codec, reference = bpe.Codec(raw), both(raw)[1]
    monkeypatch.setattr(bpe, "KEPT", 3)
    monkeypatch.setattr(bpe, "SLAB", 16)
    for k in range(4):
        texts = [f"qwzx{k} unwordlike{k}{k} zzqqkk" * 3, "unwordlike" * 9]
        assert lists(codec, texts) == [reference.encode_ordinary(t) for t in texts]


def test_very_long_pre_token(raw):
    codec, _ = both(raw)
    text = "abcab" * 40_000
    ids = codec.encode(text).tolist()
    assert codec.decode(ids) == text and len(ids) < len(text) / 2
    assert lists(codec, [text, "x" * 30_000]) == [ids, codec.encode("x" * 30_000).tolist()]


def test_table(spark, table, odd_rows):
    df = table(odd_rows)
    out = bpe.encode(df)
    rows = out.collect()
    assert len(rows) == len(odd_rows) and all(r.exact for r in rows if r.doc_id != 1)
    by = {r.doc_id: r for r in rows}
    assert by[1].ids is None and by[1].n_tokens is None and by[2].ids == [] and by[2].n_tokens == 0
    back = sorted(((r.doc_id, r.text) for r in bpe.decode(out).collect()), key=repr)
    assert back == sorted(((r[0], r[1]) for r in odd_rows), key=repr)
    assert bpe.encode(df.limit(0)).collect() == []
