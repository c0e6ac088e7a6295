import random

from llm_brute import contamination
from pyspark.sql import functions as F

from fathom.llm import decontaminate as dc


def items(corpus):
    w = corpus[97][1].split()
    return [(1, " ".join(w[100:140])), (2, " ".join(w[500:513])), (3, "ab"), (4, None), (5, ""), (6, "na na na"), (7, corpus[40][1].upper()), (7, "zz"), (None, " ".join(w[900:920])), (8, "Straße")]


def check(spark, docs, corpus, **how):
    bench = spark.createDataFrame(items(corpus), "item_id long, text string")
    out, name = dc.find_benchmark(docs, bench, **how)
    assert set(docs.columns) < set(out.columns)
    named = [(i, t) for i, t in items(corpus)]
    for r in out.select("doc_id", "text", F.col(name).alias("h"), dc.n_hit(name).alias("hit"), dc.is_contaminated(name).alias("bad")).collect():
        n, hit, found = contamination(r.text, named)
        assert (r.h.n_words, r.hit, sorted(r.h["items"])) == (n, hit, [f for f in found if f != "None"]), r.doc_id
        assert r.bad == (hit > 0 and 20 * hit >= n)


def test_whole_fixture(spark, docs, corpus):
    check(spark, docs, corpus)


def test_in_blocks(spark, docs, corpus):
    check(spark, docs, corpus, block_bytes=150)


def test_random_words_of_few_letters(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    bench = [(i, text(rng.randint(1, 20))) for i in range(12)]
    searcher = dc.Searcher([(str(i), t) for i, t in bench], window=5)
    for _ in range(60):
        t = text(rng.randint(0, 40))
        n, spans, found = searcher.find(t)
        assert (n, sum(b - a for a, b in spans), sorted(found)) == contamination(t, bench, 5)


def test_empty_tables(spark, docs, none, corpus):
    bench = spark.createDataFrame(items(corpus), "item_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert dc.drop_contaminated(none, bench).count() == 0
    kept = dc.drop_contaminated(docs, nothing)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_long_text(spark, docs, corpus):
    """Half a million words, hit at both ends."""
    bench = [(i, t) for i, t in items(corpus) if i in (1, 2)]
    long = bench[0][1] + " x y" * 250_000 + " " + bench[1][1]
    out, name = dc.find_benchmark(spark.createDataFrame([(1, long)], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    r = out.select(F.col(name).alias("h"), dc.n_hit(name).alias("hit"), dc.is_contaminated(name).alias("bad")).first()
    assert (r.h.n_words, r.hit, sorted(r.h["items"]), r.bad) == (500_053, 53, ["1", "2"], False)


def test_memory_of_the_tables():
    """Under 10 MB for each MB of items."""
    import tracemalloc

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    bench = [(str(i), " ".join(rng.choice(words) for _ in range(200))) for i in range(900)]
    size = sum(len(t) for _, t in bench)
    tracemalloc.start()
    searcher = dc.Searcher(bench)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert searcher.find(bench[5][1])[1] == [(0, 200)]
    assert size > 1_000_000 and held < 10 * size, held / size
