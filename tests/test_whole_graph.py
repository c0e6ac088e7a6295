"""The queries of the whole part graph that have no SQL twin, against plain Python on a small table whose quantities are all sizes."""

import random

import pytest
from test_graph import neighbours, plain_brandes, plain_levels, plain_merge

from fathom.plans import catalog

N = catalog.N


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A table of orders, and the neighbours of its part graph."""
    rng, d = random.Random(4), str(tmp_path_factory.mktemp("parts"))
    rows = [(o, rng.randrange(40) + 100 * (o > 24), float(rng.randint(1, 50))) for o in range(30) for _ in range(rng.randint(1, 4))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    return d, neighbours([(p, q) for o, p, _ in rows for x, q, _ in rows if o == x])


def run(spark, d, name):
    return catalog.QUERIES[f"{name}_dense"](spark, d).collect()


def test_every_part_query_has_its_whole_form():
    cut = [n for n, q in catalog.SQL.items() if catalog.G45_SQL in q]
    assert len(cut) == 29
    assert all(f"{n}_dense" in catalog.QUERIES for n in cut)
    assert not any(">= 45" in catalog.SQL.get(f"{n}_dense", "") for n in cut)


def test_components(spark, parts):
    d, nb = parts
    label = {v: min(plain_levels(nb, v)) for v in nb}
    assert len(set(label.values())) > 1
    for name in ("cc_labels", "cc_pointer_jump"):
        assert {r.id: r.component for r in run(spark, d, name)} == label
    labels = list(label.values())
    assert {r.component: r.size for r in run(spark, d, "cc_sizes")} == {c: labels.count(c) for c in set(labels)}


def test_betweenness(spark, parts):
    d, nb = parts
    level, sigma, delta = plain_brandes(nb, min(nb))
    assert {r.id: (r.level, r.sigma) for r in run(spark, d, "bc_sigma")} == {v: (level[v], sigma[v]) for v in level}
    want = {}
    for v in level:
        n, s = want.get(level[v], (0, 0))
        want[level[v]] = (n + 1, s + sigma[v])
    assert {r.level: (r.vertices, r.sigma) for r in run(spark, d, "bc_sigma_by_level")} == want
    rows = run(spark, d, "bc_delta")
    assert {r.id: (r.level, r.sigma) for r in rows} == {v: (level[v], sigma[v]) for v in level}
    assert all(abs(r.delta - delta[r.id]) < 1e-5 and abs(r.total - (delta[r.id] if r.level else 0)) < 1e-5 for r in rows)


def test_traces(spark, parts):
    d, nb = parts
    at, offset = 0, {}
    for v in sorted(nb):
        offset[v] = {x: at + i for i, x in enumerate(sorted(nb[v]))}
        at += len(nb[v])
    want = [(u, v, k, s, offset[(u, v)[s]][x]) for u in sorted(nb) for v in sorted(nb[u]) for k, (s, x) in enumerate(plain_merge(sorted(nb[u]), sorted(nb[v])))]
    assert sorted((r.src, r.dst, r.step, r.side, r.addr) for r in run(spark, d, "merge_trace")) == want
    visits = {}
    for *_, a in want[:N]:
        visits[a] = visits.get(a, 0) + 1
    for dialect, var in (("c", N), ("java", 1), ("python", N // 2)):
        got = {(r.addr, r.op): r.value for r in run(spark, d, f"trace_mix_scatter_{dialect}")}
        assert len(got) == 8 * len(visits)
        assert all(got[a, "INC"] == n and got[a, "ADD_1M"] == 1_000_000 * n and got[a, "ADD_VAR"] == var * n for a, n in visits.items())


def test_merge_trace_in_blocks_shuffles_no_list_on_edges(spark, monkeypatch):
    """Nearly all edges of 200 vertices, whose lists on the edges were some 100 MB; ids are far apart and near each other."""
    from fathom.operators import merges
    from fathom.operators import triangles as tri
    from fathom.operators.graph import Graph

    rng, n = random.Random(5), 200
    ids = sorted([rng.randint(-(1 << 62), 1 << 62) for _ in range(n // 2)] + rng.sample(range(10_000), n // 2))
    pairs = [(a, b) for a in ids for b in ids if a < b and rng.random() < 0.9]
    monkeypatch.setattr(merges, "LEAST_BLOCK", 1_000)
    monkeypatch.setattr(merges, "STEP", 5_000)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before, trace = written(), tri.merge_trace(Graph.from_pairs(spark.createDataFrame(pairs, "src long, dst long")))
        got = sorted(map(tuple, trace.toPandas().itertuples(index=False)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    nb, at, offset = neighbours(pairs), 0, {}
    for v in sorted(nb):
        offset[v] = {x: at + i for i, x in enumerate(sorted(nb[v]))}
        at += len(nb[v])
    assert got == [(u, v, k, s, offset[(u, v)[s]][x]) for u in sorted(nb) for v in sorted(nb[u]) for k, (s, x) in enumerate(plain_merge(sorted(nb[u]), sorted(nb[v])))]
    assert written() - before < 2e6  # it was 3.6 MB with lists on the edges, which compress well here


def test_merge_trace_shuffles_lists_once_whatever_their_neighbours(spark, monkeypatch):
    """Every vertex has neighbours in nearly all blocks."""
    from fathom.operators import merges
    from fathom.operators import triangles as tri
    from fathom.operators.graph import Graph

    rng = random.Random(6)
    ids = rng.sample(range(1 << 40), 400)
    pairs = [(a, b) for a in ids for b in ids if a < b and rng.random() < 0.2]
    monkeypatch.setattr(merges, "LEAST_BLOCK", 1_000)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before, trace = written(), tri.merge_trace(Graph.from_pairs(spark.createDataFrame(pairs, "src long, dst long")))
    got, after = trace.toPandas(), written()
    assert len(got) == sum(r.steps for r in tri.merge_steps(Graph.from_pairs(spark.createDataFrame(pairs, "src long, dst long"))).collect())
    assert not got.duplicated(["src", "dst", "step"]).any()
    assert after - before < 9e5  # it was 1.7 MB with lists in the blocks of their neighbours, and is 0.45
