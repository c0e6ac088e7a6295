import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathom.llm import tokens
from fathom.plans.staging import Workspace

CODER = tokens.Encoder(tokens.word_tokenizer())
ODD = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\x1c\x85'’<|>ÀéßİıſΣςﬁ²½0aAsStT_-.")), max_size=40)


def whole(text):
    return CODER.whole.encode(text or "", add_special_tokens=False).ids


def ids(raw):
    return np.frombuffer(raw, np.uint16).tolist()


@settings(max_examples=1500, deadline=None)
@given(ODD)
def test_same_ids_as_the_library(text):
    assert ids(CODER.encode(text)) == whole(text)


@pytest.mark.parametrize("text", ["it's I'LL don't 's", "a<|endoftext|>b <|startoftext|>", "é é ﬁ Ⅷ ٣ x²", "a b　c\x1cd", "under_score __x__ 12ab3"])
def test_hard_texts(text):
    assert ids(CODER.encode(text)) == whole(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \t\n\r\x0b'sStTrReEvVmMlLdD0129-_.,<>|ÀéßŸıſ×÷«»ŉ"), max_size=40))
def test_same_ids_of_latin_texts(text):
    assert ids(CODER.encode(text)) == whole(text)


def test_long_texts_in_slices(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 7)
    for text in ["one two three four five six", "averyveryverylongword and more", " lead  and trail ", "é'll x" * 20, "日本 x y z " * 9]:
        assert ids(CODER.encode(text)) == whole(text)


def test_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNKS", 3)
    monkeypatch.setattr(tokens, "PIECES", 2)
    coder = tokens.Encoder(tokens.word_tokenizer())
    for t in ["one two three four five", "six seven eight nine", "one six ten"] * 2:
        assert ids(coder.encode(t)) == whole(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=1500), st.integers(9, 16))
def test_wavelet(values, bits):
    x = np.array(values, np.uint32)
    w = tokens.Wavelet.build(x, bits)
    assert w.ids().tolist() == values
    for i in range(0, len(values), 97):
        assert w.access(i) == values[i]
    for v in {*values[:3], 7}:
        assert w.count(v) == values.count(v) and list(w.positions(v)) == [i for i, y in enumerate(values) if y == v]
        assert w.count(v, len(values) // 3, len(values) // 2) == values[len(values) // 3 : len(values) // 2].count(v)


def test_file_round_trip():
    d, n, x = np.array([-(1 << 63), 5, 5, 9]), np.array([1, 2, 0, 3]), np.array([1, 2, 3, 40000, 2, 2], np.uint16)
    a, b, w = tokens.unpack(tokens.pack(d, n, x, 16))
    assert a.tolist() == d.tolist() and b.tolist() == n.tolist() and w.ids().tolist() == x.tolist()
    assert w.count(2) == 3 and list(w.positions(2)) == [1, 4, 5] and w.access(3) == 40000
    with pytest.raises(ValueError):
        tokens.unpack(b"nope")


@pytest.mark.parametrize("shard", [50, 1 << 20])
def test_table(docs, corpus, none, shard):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.token_table(docs, shard_tokens=shard).collect())
    want, at = [], 0
    for d, t, *_ in sorted(corpus, key=lambda r: r[0]):
        b = np.array([*whole(t), 2], "<u4").tobytes()
        want.append((d, at, len(b) // 4, zlib.crc32(b)))
        at += len(b) // 4
    assert got == sorted(want)
    assert tokens.token_table(none).count() == 0


def test_files_answer_queries(docs, spark):
    space = Workspace(spark)
    files = tokens.write_shards(docs, space, "f", tokens.word_tokenizer(), shard_tokens=500)
    rows = files.orderBy("shard").collect()
    assert len(rows) > 3
    _, lengths, w = tokens.unpack(bytes(rows[0].payload))
    assert w.count(tokens.END) >= len(lengths) and sum(lengths) == w.n == rows[0].n_tokens


def test_many_rows_of_one_id(spark):
    """Rows without an id are dealt to several tasks and still come first."""
    rows = [(None if i % 3 else i, f"text number {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    space = Workspace(spark)
    files = tokens.write_shards(docs, space, "f", tokens.word_tokenizer(), shard_tokens=40)
    first = files.where(f"first_doc = {tokens.NULL_ID}")
    assert first.select("shard").rdd.map(lambda r: r.shard >> 32).distinct().count() > 1
    got = tokens.read_shards(files).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert at == sum(len(whole(t)) + 1 for _, t in rows)
