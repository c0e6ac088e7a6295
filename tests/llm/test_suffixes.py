import random

import pytest
from llm_brute import removed
from pyspark.sql import functions as F

from fathom.llm import suffixes


def result(df, **how):
    return sorted((r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in suffixes.remove_repeats(df, **how).collect())


def expected(rows, length):
    out = []
    for d, b, spans in removed([(d, t) for d, t, *_ in rows], length):
        kept, at = b"", 0
        for a, e in spans:
            kept, at = kept + b[at:a], e
        out.append((d, len(b), tuple(spans), kept + b[at:]))
    return sorted(out)


def test_whole_fixture(docs, corpus):
    assert result(docs) == expected(corpus, 100)


@pytest.mark.parametrize(("length", "first"), [(12, 4), (20, 20), (7, 1)])
def test_small_alphabet_and_lengths(spark, length, first):
    rng = random.Random(length)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(50)] + [(99, "ab" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(df, length=length, first=first) == expected(rows, length)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 64)
    rng = random.Random(3)
    part = "".join(rng.choice("abc") for _ in range(50))
    rows = [(1, part + "".join(rng.choice("xyz") for _ in range(400)) + part), (2, "q" + part)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, length=20, first=8) == expected(rows, 20)


def test_empty_table_and_null_id(spark, none):
    assert result(none) == []
    df = spark.createDataFrame([(None, "x" * 120), (5, "x" * 110)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.remove_repeats(df).collect()}
    assert bytes(got[5].kept) == b"" and len(got[None].kept) == 1  # the null id is the smallest


def test_different_texts_of_one_id(spark):
    rng = random.Random(11)
    shared = "".join(rng.choice("abcd") for _ in range(300))
    rows = []
    for _ in range(60):
        a = rng.randrange(250)
        text = "".join(rng.choice("wxyz") for _ in range(rng.randint(0, 40))) + shared[a : a + rng.randint(0, 80)] + "".join(rng.choice("wxyz") for _ in range(rng.randint(0, 40)))
        rows += [(rng.choice([None, 3, 4, 5]), text)] * rng.choice([1, 1, 2])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    low = [(suffixes.NULL_ID if d is None else d, t) for d, t in rows]
    got = sorted((suffixes.NULL_ID if r.doc_id is None else r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in suffixes.remove_repeats(df, length=20, first=8).collect())
    assert got == expected(low, 20)


def test_kept_hash_matches_operator(docs):
    out = suffixes.remove_repeats(docs)
    assert out.where(F.octet_length("kept") > F.col("n_bytes")).count() == 0


def test_a_line_that_thousands_share(spark):
    """90 bytes inside texts that differ: one first rank, and as many runs.  No bucket of ranks gets more than a few of them a step."""
    rng = random.Random(17)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    texts = ["".join(rng.choice("tuvwxyz ") for _ in range(60)) + line + "".join(rng.choice("tuvwxyz ") for _ in range(60)) for _ in range(5000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(9000, texts[17]), (9001, texts[40][30:]), (9002, texts[41][:170] + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    ranks = suffixes.first_ranks(df, 64, 100, 40).where(F.col("kind") == suffixes.RANKS)
    sizes = [len(suffixes.unpack(r.piece, "uuiis")[0]) for r in ranks.groupBy("bucket", "piece").count().collect()]
    by_bucket = {}
    for r in ranks.collect():
        by_bucket[r.bucket] = by_bucket.get(r.bucket, 0) + len(suffixes.unpack(r.piece, "uuiis")[0])
    assert max(by_bucket.values()) < 0.1 * sum(sizes)
    assert result(df) == expected(rows, 100)


def test_marks_open_what_other_steps_have(spark, monkeypatch):
    """One step knows that a rank is crowded; the earliest copy is in another step."""
    monkeypatch.setattr(suffixes, "CROWD", 2)
    rng = random.Random(23)
    line = "".join(rng.choice("ab") for _ in range(14))
    rows = [(i, "".join(rng.choice("cd") for _ in range(rng.randint(0, 9))) + line + "".join(rng.choice("cd") for _ in range(rng.randint(0, 9)))) for i in range(200)]
    for parts in (1, 2, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
        assert result(df, length=20, first=8) == expected(rows, 20)


@pytest.mark.parametrize("length", [5, 8, 20])
def test_plain_doubling(spark, length):
    rng = random.Random(length)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in range(30)] + [(50, None), (51, ""), (52, "ba" * 30)]
    got = sorted(map(tuple, suffixes.doubled(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect()))
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    want = [(d, p) for d, b in data for p in range(len(b) - length + 1) if first.setdefault(b[p : p + length], (d, p)) != (d, p)]
    assert got == sorted(want)
