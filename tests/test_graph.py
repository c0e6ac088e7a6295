"""Kernels on hand-checked graphs and against plain Python on random ones."""

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from fathom.operators import betweenness as bc
from fathom.operators import bfs, components, traces
from fathom.operators import triangles as tri
from fathom.operators.graph import Graph

TINY = {
    "path5": [(1, 2), (2, 3), (3, 4), (4, 5)],
    "cycle4": [(1, 2), (2, 3), (3, 4), (4, 1)],
    "tri_tail": [(1, 2), (2, 3), (1, 3), (3, 4)],
    "star": [(1, 2), (1, 3), (1, 4)],
    "two": [(1, 2), (3, 4), (4, 5)],
}


def graph(spark, pairs, isolated=None):
    return Graph.from_pairs(spark.createDataFrame(pairs, "src long, dst long"), vertices=None if isolated is None else spark.createDataFrame([(i,) for i in isolated], "id long"))


def neighbours(pairs):
    out = {}
    for a, b in pairs:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def plain_levels(nb, root):
    level, queue = {root: 0}, deque([root])
    while queue:
        v = queue.popleft()
        for w in nb[v]:
            if w not in level:
                level[w] = level[v] + 1
                queue.append(w)
    return level


def plain_brandes(nb, root):
    level = plain_levels(nb, root)
    order = sorted(level, key=level.get)
    sigma, delta = {root: 1}, dict.fromkeys(level, 0.0)
    for v in order[1:]:
        sigma[v] = sum(sigma[w] for w in nb[v] if level[w] == level[v] - 1)
    for w in reversed(order):
        for v in nb[w]:
            if level[v] == level[w] - 1:
                delta[v] += sigma[v] * (1 + delta[w]) / sigma[w]
    return level, sigma, delta


def plain_merge(a, b):
    """(side, value) touched by a two-pointer merge."""
    if a[0] > b[-1] or b[0] > a[-1]:
        return []
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out += [(0, a[i]), (1, b[j])]
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            out.append((0, a[i]))
            i += 1
        else:
            out.append((1, b[j]))
            j += 1
    m = min(a[-1], b[-1])
    return out + [(0, x) for x in a[i:] if x <= m] + [(1, x) for x in b[j:] if x <= m]


@pytest.fixture(scope="module")
def randoms():
    rng = random.Random(11)
    return [(rng.randrange(40), rng.randrange(40)) for _ in range(70)]


def test_canonical_edges(spark):
    g = graph(spark, [(1, 2), (1, 2), (2, 1), (1, 1), (None, 3)], isolated=[9])
    assert sorted(map(tuple, g.edges.collect())) == [(1, 2), (2, 1)]
    assert sorted(map(tuple, g.degrees().collect())) == [(1, 1), (2, 1), (9, 0)]


@pytest.mark.parametrize("name", ["path5", "cycle4", "tri_tail", "star", "two"])
@pytest.mark.parametrize("direction", ["push", "pull", "auto"])
def test_levels(spark, name, direction):
    got = {r.id: r.level for r in bfs.levels(graph(spark, TINY[name]), direction=direction).collect()}
    assert got == plain_levels(neighbours(TINY[name]), 1)


def test_random_graph(spark, randoms):
    g, nb = graph(spark, randoms), neighbours(randoms)
    root = min(nb)
    level, sigma, delta = plain_brandes(nb, root)
    rows = bc.betweenness(g).collect()
    assert {r.id: r.level for r in rows} == level and {r.id: r.sigma for r in rows} == sigma
    assert all(abs(r.delta - delta[r.id]) < 1e-9 for r in rows)
    stats = bfs.level_stats(g, bfs.levels(g)).collect()
    assert sum(r.edges for r in stats) == sum(len(nb[v]) for v in level)
    labels = {r.id: r.component for r in components.component_labels(g).collect()}
    assert labels == {v: min(plain_levels(nb, v)) for v in nb}
    for jump in (True, False):
        assert {r.id: r.component for r in components.label_rounds(g, jump).collect()} == labels
    a = {(r.src, r.dst): r.triangles for r in tri.edge_triangles(g).collect()}
    b = {(r.src, r.dst): r.triangles for r in tri.edge_intersections(g).collect()}
    assert a == b == {(u, v): len(nb[u] & nb[v]) for u in nb for v in nb[u]}
    assert sum(a.values()) % 6 == 0 and sum(a.values()) == 6 * tri.triangles_oriented(g).count() == 6 * tri.triangle_count(g).first()[0]
    steps = {(r.src, r.dst): r.steps for r in tri.merge_steps(g).collect()}
    traced = {}
    for r in tri.merge_trace(g).orderBy("src", "dst", "step").collect():
        traced.setdefault((r.src, r.dst), []).append((r.side, r.addr))
    off, at = {}, 0
    for v in sorted(nb):
        off[v] = {w: at + i for i, w in enumerate(sorted(nb[v]))}
        at += len(nb[v])
    for u, v in a:
        touched = plain_merge(sorted(nb[u]), sorted(nb[v]))
        assert steps[u, v] == len(touched)
        assert traced.get((u, v), []) == [(s, off[(u, v)[s]][x]) for s, x in touched]


def test_clustering(spark):
    g = graph(spark, TINY["tri_tail"], isolated=[5])
    cc = {r.id: round(r.cc, 4) for r in tri.clustering(tri.vertex_triangles(g)).collect()}
    assert cc == {1: 1.0, 2: 1.0, 3: 0.3333, 4: 0.0, 5: 0.0}
    legacy = {r.id: round(r.cc, 4) for r in tri.clustering(tri.vertex_triangles(g), legacy=True).collect()}
    assert legacy[3] == 0.25 and legacy[1] == 0.6667
    assert tri.triangle_total(tri.edge_triangles(g)).first() == (6, 1)


def test_empty_graph(spark):
    g = graph(spark, [])
    assert bfs.levels(g).count() == bc.betweenness(g).count() == components.component_labels(g).count() == 0
    assert components.component_labels(graph(spark, [], isolated=[3, 4])).count() == 2


def test_differences(spark):
    a = spark.createDataFrame([(1, 2, 0.5), (2, 3, 1.0)], "id long, level long, delta double")
    assert bc.differences(a, a.withColumn("delta", F.col("delta") + 1e-9), ["level"], ["delta"]).count() == 0
    assert bc.differences(a, a.where("id = 1"), ["level"], ["delta"]).count() == 1


def plain_scatter(pattern, n, dialect, b):
    """Cell values after running each operation over the pattern, address by address."""
    steps = {
        "c": {"ADD_VAR": lambda i, out: n, "COND_GEQ": lambda i, out: i <= b, "COND_EQ": lambda i, out: i == b, "COND_3": lambda i, out: (i == b) + (i >= b) + 2 * (i < b), "BRANCH": lambda i, out: b if i >= b else 1},
        "java": {"ADD_VAR": lambda i, out: 1, "COND_GEQ": lambda i, out: out >= 0, "COND_EQ": lambda i, out: out == 0, "COND_3": lambda i, out: 3 if out == 0 else 1, "BRANCH": lambda i, out: b if i >= b else 1},
        "python": {"ADD_VAR": lambda i, out: n // 2, "COND_GEQ": lambda i, out: i >= 0, "COND_EQ": lambda i, out: i == 0, "COND_3": lambda i, out: 3 if i == 0 else 1, "BRANCH": lambda i, out: b if i > b else 1},
    }[dialect] | {"MEM_ONLY": lambda i, out: 0, "INC": lambda i, out: 1, "ADD_1M": lambda i, out: 1_000_000}
    cells = {}
    for op, step in steps.items():
        for i in pattern:
            cells[i, op] = cells.get((i, op), 0) + int(step(i, cells.get((i, op), 0)))
    return cells


def test_scatter_dialects(spark):
    trace = spark.createDataFrame([(i, a) for i, a in enumerate([0, 0, 1, 3, 3, 3])], "pos long, addr long")
    got = {d: {(r.addr, r.op): r.value for r in traces.scatter(trace, 6, d, 3).collect()} for d in traces.DIALECTS}
    assert got["c"][3, "BRANCH"] == 9 and got["python"][3, "BRANCH"] == 3 and got["java"][3, "COND_EQ"] == 1
    assert got["c"][0, "COND_GEQ"] == 2 and got["c"][3, "ADD_VAR"] == 18 and got["python"][0, "COND_3"] == 6 and got["java"][1, "COND_3"] == 3
    for d in traces.DIALECTS:
        for branch in (0, 1, 2, 3):
            ops = {(r.addr, r.op): r.value for r in traces.scatter(trace, 6, d, branch).collect()}
            assert ops == plain_scatter([0, 0, 1, 3, 3, 3], 6, d, branch)
    assert traces.normalised({"MEM_ONLY": 1.0, "INC": 1.0, "BRANCH": 3.0})["BRANCH"] is None


def test_stream_degrees(spark, tmp_path):
    from fathom.streaming.degrees import stream_degrees

    spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "src long, dst long").write.parquet(f"{tmp_path}/in")
    q = stream_degrees(spark.readStream.schema("src long, dst long").parquet(f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("deg").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("deg").collect()] == [(1, 2)]


@pytest.mark.parametrize(("block", "hub"), [(40, 5_000), (10**9, 6), (40, 3), (40, 0)])
def test_triangles_by_blocks_and_hubs(spark, randoms, monkeypatch, block, hub):
    """Lists meet lists, in one block or several, without a row a wedge; hubs go by their triangles."""
    monkeypatch.setattr(tri, "BLOCK", block)
    monkeypatch.setattr(tri, "HUB", hub)
    star = [(1000, v) for v in {u for e in randoms for u in e}]
    for pairs in (randoms, [*randoms, *star]):
        g, nb = graph(spark, pairs), neighbours(pairs)
        got = [tuple(r) for r in tri.edge_intersections(g).collect()]
        assert sorted(got) == sorted((u, v, len(nb[u] & nb[v]), len(nb[u]) + len(nb[v])) for u in nb for v in nb[u])
        per_vertex = {r.id: (r.deg, r.triangles) for r in tri.vertex_triangles(g).collect()}
        assert per_vertex == {u: (len(nb[u]), sum(len(nb[u] & nb[v]) for v in nb[u])) for u in nb}


def test_start_of_the_merge_trace(spark, randoms):
    """The first rows need the lists of the first edges only; edges without steps come before the first one that has some."""
    for pairs, sizes in ((randoms, (1, 50, 10**6)), ([(0, 100), (100, 200), (200, 300), (1, 2), (1, 3), (2, 3)], (1, 4, 10**6)), ([], (5,))):
        g = graph(spark, pairs)
        whole = sorted(map(tuple, tri.merge_trace(g).collect()))
        for n in sizes:
            got = sorted(map(tuple, tri.merge_trace_start(g, n).collect()))
            assert got[:n] == whole[:n] and got == whole[: len(got)]
            if n == 50:
                assert len(got) < len(whole)


def test_labels_without_broadcasts(spark, randoms, monkeypatch):
    """Beyond BROADCAST_ROWS labels no join of a round passes through the driver."""
    want = sorted(map(tuple, components.component_labels(graph(spark, randoms)).collect()))
    monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    plans, kept = [], components.checkpoint
    monkeypatch.setattr(components, "checkpoint", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    for jump in (True, False):
        assert sorted(map(tuple, components.label_rounds(graph(spark, randoms), jump).collect())) == want
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_labels_that_meet_become_one_in_a_round(spark, monkeypatch):
    """A path of mixed ids takes few rounds, and large ones give back what a round leaves in the driver."""
    rng, freed, rounds, kept = random.Random(7), [], [], components.checkpoint
    path = rng.sample(range(1_000), 400)
    pairs = [*itertools.pairwise(path), (2_000, 2_001)]
    monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(components, "checkpoint", lambda df: (rounds.append(1), kept(df))[1])
    monkeypatch.setattr(components, "trim_driver", freed.append, raising=False)
    got = {r.id: r.component for r in components.label_rounds(graph(spark, pairs), max_rounds=12).collect()}  # it took 87
    assert got == dict.fromkeys(path, min(path)) | {2_000: 2_000, 2_001: 2_000}
    assert len(freed) == len(rounds) - 2  # the first one is no round, and after the last nothing is given back
