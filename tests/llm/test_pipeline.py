import os

import pytest
import zlib

import numpy as np
from llm_helpers import by_source, frame
from llm_brute import components, contamination, targets

import corpus_pipeline
from fathom.llm import tokens


def test_stages_against_plain(spark, corpus, tmp_path):
    """Every stage on all that the one before kept, with its decision checked against the plain version."""
    w = corpus[97][1].split()
    bench = [(1, " ".join(w[100:200])), (2, corpus[20][1] + " and more words that appear nowhere else"), (3, corpus[30][1])]
    frame(spark, corpus).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "tokens":
            assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    ids = lambda name: sorted(r.doc_id for r in kept[name])
    rows = [r for r in corpus if r[1] and any(map(str.isalpha, r[1]))]
    assert ids("language") == sorted(r[0] for r in rows)
    least = components([(d, t) for d, t, *_ in rows])
    rows = [r for r in rows if least[r[0]] == r[0]]
    assert ids("near_copies") == sorted(r[0] for r in rows)

    def clean(text):
        n, hit, _ = contamination(text, bench)
        return not (hit and 20 * hit >= n)

    rows = [r for r in rows if clean(r[1])]
    assert ids("decontaminate") == sorted(r[0] for r in rows)
    sizes = by_source(rows)
    want, got = targets(sizes), dict.fromkeys(sizes, 0)
    texts = {r[0]: r[1] for r in rows}
    for r in kept["mix"]:
        assert r.text == texts[r.doc_id]
        got[r.source] += len(r.text.split())
    longest = {s: max(len(r[1].split()) for r in rows if r[3] == s) for s in sizes}
    assert all(abs(got[s] - want[s]) <= 3 * longest[s] for s in sizes)
    coder = tokens.Encoder(tokens.word_tokenizer()).whole
    at, expected = 0, []
    for r in sorted(kept["mix"], key=lambda r: r.doc_id):
        b = np.array([*coder.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes()
        expected.append((r.doc_id, at, len(b) // 4, zlib.crc32(b)))
        at += len(b) // 4
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in kept["tokens"]) == sorted(expected)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.select("doc_id", "start", "ids_crc32").collect())) == sorted((r.doc_id, r.start, r.ids_crc32) for r in kept["tokens"])


def stage(spark, name, docs, sf_dir):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)


@pytest.fixture(scope="module")
def bench_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("bench"))
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_without_documents(spark, bench_dir, none):
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, none, bench_dir)
        assert out.count() == 0, name
        assert name == "tokens" or out.columns == none.columns


def test_stages_with_nulls_and_repeated_rows(spark, bench_dir):
    """Rows without ids, texts, languages or sources, and repeated ones, go through every stage; columns of clashing names stay."""
    long = " ".join(f"long{i}" for i in range(30_000))
    rows = [(None, "one text that has no id of its own", "en", "a"), (None, None, None, None), (1, "", "en", None), (2, "some words of a document here", None, None), (2, "some words of a document here", None, None), (3, long, "de", "b"), (4, "1234 5678", "de", "b"), (5, " ".join(f"q{i}" for i in range(20)), "en", "a")]
    docs = spark.createDataFrame([(*r, 7, "k", 1) for r in rows], "doc_id long, text string, lang string, source string, row_key long, lang_pred string, times int")
    kept = lambda df: sorted((str(r.doc_id), str(r.text)[:12]) for r in df.collect())
    every = kept(docs)
    out = stage(spark, "language", docs, bench_dir)
    assert out.columns == docs.columns and kept(out) == [x for x in every if x[1][:1].isalpha() and x[1] != "None"]
    out = stage(spark, "near_copies", docs, bench_dir)
    assert out.columns == docs.columns and kept(out) == every
    out = stage(spark, "decontaminate", docs, bench_dir)
    assert out.columns == docs.columns and kept(out) == [x for x in every if x[0] != "5"]
    out = stage(spark, "mix", docs, bench_dir)
    assert out.columns == docs.columns and set(kept(out)) <= {x for x in every if x[1] not in ("None", "")}
    out = stage(spark, "tokens", docs, bench_dir).collect()
    assert len(out) == len(rows) and sum(r.doc_id is None for r in out) == 2 and min(r.n_tokens for r in out) == 1


def test_run_leaves_the_stages_results_only(spark, tmp_path):
    """Each stage's intermediate tables are dropped when its result is written."""
    rows = [(i, f"words of document number {i} and more of them {i * i}", "en" if i % 2 else "de", "s") for i in range(40)]
    spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = set(os.listdir("/tmp/checkpoints")) if os.path.isdir("/tmp/checkpoints") else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = [d for d in set(os.listdir("/tmp/checkpoints")) - before if d.startswith("fathom-")]
    assert out.count() > 0 and len(left) == 1 and sorted(os.listdir(f"/tmp/checkpoints/{left[0]}")) == sorted(n for n, _ in corpus_pipeline.STAGES)
