import re

import pytest
from llm_helpers import by_source
from llm_brute import targets
from pyspark.sql import functions as F

from fathom.llm import mixture


def rows_of(df):
    return mixture.mix(df)[1].collect()


def check(rows, corpus, block=mixture.BLOCK):
    assert len(rows) == len(corpus)
    sizes = by_source(corpus)
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, n in sizes.items():
        assert abs(taken[s] - want[s]) <= 2 * block + 0.05 * want[s], (s, taken[s], want[s])


def test_whole_fixture(docs, corpus):
    rows = rows_of(docs)
    check(rows, corpus)
    texts = {d: t for d, t, *_ in corpus}
    assert all(r["size"] == len(re.findall("[^\x20\x09-\x0d]+", texts[r.doc_id] or "")) for r in rows)


def test_reruns_agree(docs):
    key = lambda df: sorted((r.doc_id, r.taken) for r in rows_of(df))
    assert key(docs) == key(docs.repartition(9))


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 5000, None: 40}, {"a": 0, "b": 300}, {"x": 7}, {"a": 100, "b": 100, "c": 100, "d": 10000, "é": 50, "z": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixture.targets(df).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_slots_are_blocks_of_the_sources(docs, corpus):
    slots, documents = mixture.mix(docs, block=8, shard=16)
    rows = slots.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.shard == r.slot // 16 for r in rows)
    keys = [(r.source_no, r.round, r.block) for r in rows]
    assert len(set(keys)) == len(keys)  # no block twice in a round
    shares = {}
    for r in rows:
        shares.setdefault(r.shard, []).append(r.source_no)
    assert len({tuple(sorted(s)) for s in shares.values()}) > 1  # counts differ from shard to shard
    check(documents.collect(), corpus, 8)


def test_permutation(spark):
    for a, b in [(1, 1), (3, 2), (7, 7), (12, 11)]:
        df = spark.range(a * b).select(mixture.permuted(F.col("id"), F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit(5), F.lit(0)).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(a * b))


def test_repeated_documents(docs, corpus, none):
    out = mixture.repeat_documents(docs)
    assert out.columns == docs.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    size = {d: len((t or "").split()) for d, t, *_ in corpus}
    assert all(size[d] and n <= 4 for d, n in times.items())
    assert mixture.repeat_documents(none).count() == 0 and rows_of(none) == []


def test_no_python_in_the_plan(docs):
    plan = mixture.mix(docs)[1]._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_small_sources_come_near_their_targets(spark):
    rows = [(i, " ".join(["w"] * 10), "big") for i in range(400)] + [(1000 + i, "a b", "tiny") for i in range(5)] + [(2000 + i, "x " * 30, "mid") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixture.mix(df)[1].groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 2 + 0.03 * r.target for r in out), out


def test_rows_without_an_id(spark):
    """Rows of no id, and repeated ones, are rows of their own."""
    rows = [(None, f"some words {i} here", "a") for i in range(300)] + [(None, "the same text", "a")] * 50 + [(7, None, None)]
    out = mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4))[1].collect()
    assert len(out) == 351 and all(0 <= r.taken <= 2 * r["size"] for r in out)
    assert abs(sum(r.taken for r in out) - 1.5 * (300 * 4 + 50 * 3)) < 60


def test_draw_against_plain(docs):
    """Replays the mix from its slots: each takes the words of one block, each source's documents laid end to end by run."""
    slots, documents = mixture.mix(docs)
    rows = slots.collect()
    plan = {(r.source_no, r.round, r.block) for r in rows}
    assert len(plan) == len(rows)
    got = documents.collect()
    assert sum(r.taken for r in got) > 0
    # the words of a source's blocks, as many as its documents have taken
    sizes = {}
    for r in got:
        sizes.setdefault(r.source, [r.source_size, 0])[1] += r.taken
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    for no, name in enumerate(names, 1):
        size, taken = sizes[name]
        words = max(1, min(mixture.BLOCK, size // mixture.LEAST_BLOCKS))
        blocks = [max(0, min(size, (b + 1) * words) - b * words) for n, _, b in plan if n == no]
        assert sum(blocks) == taken, name
