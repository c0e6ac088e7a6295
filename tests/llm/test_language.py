import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from fathom.llm import language as lg


def plain_bits(samples, text, depth):
    """Code length by walking a dictionary of contexts."""
    seen = defaultdict(lambda: defaultdict(int))
    for s in samples:
        b = bytes(depth) + s
        for i in range(depth, len(b)):
            for k in range(depth + 1):
                seen[b[i - k : i]][b[i]] += 1
    b, bits = bytes(depth) + text, 0.0
    for i in range(depth, len(b)):
        for k in range(depth, -1, -1):
            ctx = seen.get(b[i - k : i])
            if not ctx:
                continue
            t, q = sum(ctx.values()), len(ctx)
            if b[i] in ctx:
                bits += math.log2((t + q) / ctx[b[i]])
                break
            bits += math.log2((t + q) / q)
        else:
            bits += 8.0
    return bits


def test_code_lengths_are_exact():
    samples = {"a": [b"the cat sat on the mat", b"that hat"], "b": ["der Hund läuft".encode(), b"und die Katze"]}
    texts = [b"the mat", "läuft\x00".encode(), b"zzz", b"", b"x", "Hände der Katze".encode() * 30]
    got = lg.Scorer(lg.train(samples, 3)).bits(texts)
    for i, t in enumerate(texts):
        for k, name in enumerate(sorted(samples)):
            assert abs(got[i, k] - plain_bits(samples[name], t, 3)) < 1e-3 * max(1, len(t))


def test_long_batches_are_cut(monkeypatch):
    samples = {"a": [b"abcabc" * 20], "b": [b"cbacba" * 20]}
    texts = [b"abc" * n for n in (1, 700000, 3)]
    got = lg.Scorer(lg.train(samples)).bits(texts)
    one = np.vstack([lg.Scorer(lg.train(samples)).bits([t]) for t in texts])
    assert np.allclose(got, one, rtol=1e-6)


def test_held_out_accuracy(docs, corpus):
    out, lang, score = lg.identify(docs)
    rows = out.select("doc_id", "text", "lang", F.col(lang).alias("p"), F.col(score).alias("s"), lg.held_out().alias("h")).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (r.p, r.s) == ("und", 0.0)
        assert 0 <= r.s <= 1
    told = [r.p == r.lang for r in rows if r.h and r.lang and r.p != "und" and r.doc_id < 70 and len(r.text) > 30]
    assert len(told) > 5 and sum(told) >= 0.95 * len(told)


def test_same_every_time(docs):
    a, lang, score = lg.identify(docs)
    b, *_ = lg.identify(docs.repartition(7))
    key = lambda df: sorted((r.doc_id, r[lang], round(r[score], 9)) for r in df.collect())
    assert key(a) == key(b)


def test_nothing_to_learn_from(none, docs):
    out, lang, _ = lg.identify(none)
    assert out.count() == 0
    out, lang, _ = lg.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r[lang] for r in out.collect()} == {"und"}


def test_real_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out, lang, _ = lg.identify(d)
    good = out.where(lg.held_out()).agg(F.avg((F.col(lang) == F.col("lang")).cast("int"))).first()[0]
    assert good > 0.98


def test_copies_count_once_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(lg, "BYTES_PER_LANG", 600)
    rows = [("x", f"text number {i:03d}") for i in range(100)]
    plain = lg.sample(spark.createDataFrame(rows, "lang string, text string"), "text", "lang")
    copied = lg.sample(spark.createDataFrame(rows * 20 + [("y", None), (None, "z")], "lang string, text string"), "text", "lang")
    assert plain == copied and 0 < sum(map(len, plain["x"])) < 1500
