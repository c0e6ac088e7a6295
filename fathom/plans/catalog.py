"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import fmt, keys
from fathom.operators import betweenness as bc
from fathom.operators import bfs, components, models, traces
from fathom.operators import relational as rel
from fathom.operators import triangles as tri
from fathom.operators.graph import Graph
from fathom.plans import fixtures as fx
from fathom.plans.fixtures import ADJ_SQL, BFS_SQL, BIP_SQL, CC_SQL, DEG_SQL, EVT_SQL, G45_SQL, GALL_SQL, MERGE_SQL, PATHS_SQL, PERF_KEYS, PERF_SQL, PERF_VALUES, TRACE_SQL, TRI_SQL, VTRI_SQL, r6
from fathom.sources.perflog import union_fill

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def w(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


G = fx.part_graph
#: Queries whose SQL twin is too slow, or its result too long, on the whole part graph: all walks, all pairs or all paths.  They have none
#: there; tests/test_whole_graph.py holds them against plain Python.
NO_WHOLE_SQL = ("cc_", "bc_", "merge_trace", "trace_mix_")


def part_query(name: str, sql: str) -> Callable[[Callable[[Graph], DataFrame]], Query]:
    """Register a query of the part graph on lines of large quantity (``name``) and on the whole table (``name``_dense)."""
    if G45_SQL not in sql:
        raise ValueError(f"{name}: no part graph in its SQL")

    # searches go through the edges many times
    read = Graph.store if name.startswith(("bfs_", "cc_", "bc_")) else lambda g: g

    def add(f: Callable[[Graph], DataFrame]) -> Query:
        if f"{name}_dense" not in WHOLE_ALREADY:
            query(f"{name}_dense", None if name.startswith(NO_WHOLE_SQL) else sql.replace(G45_SQL, GALL_SQL))(lambda s, d: f(read(G(s, d, None))))
        return query(name, sql)(lambda s, d: f(read(G(s, d))))

    return add


#: Registered below by hand.
WHOLE_ALREADY = ("tri_edge_counts_dense",)

# --- graph model ---------------------------------------------------------------------------------------------------------------

part_query("graph_edges_symmetric", w(G45_SQL) + "SELECT src, dst FROM e")(lambda g: g.edges)
query("graph_edges_bipartite", w(BIP_SQL) + "SELECT src, dst FROM e")(lambda s, d: fx.trade_graph(s, d).edges)
part_query("graph_degree", w(G45_SQL, DEG_SQL) + "SELECT id, deg FROM d")(lambda g: g.degrees())
query("graph_degree_histogram", w(GALL_SQL, DEG_SQL) + "SELECT deg, count(*) AS vertices FROM d GROUP BY 1")(lambda s, d: G(s, d, None).degree_histogram())
text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
part_query("graph_adjacency", w(G45_SQL, ADJ_SQL) + "SELECT id, array_to_string(nbrs, ' ') AS nbrs, deg FROM adj")(lambda g: g.adjacency().select("id", text("nbrs").alias("nbrs"), "deg"))
part_query("graph_unsort", w(G45_SQL) + "SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY (dst * 1103515245 + src * 12345) % 2147483647, dst) AS nbrs FROM e GROUP BY 1")(lambda g: g.unsorted().select("id", text("nbrs").alias("nbrs")))

# --- traversal -----------------------------------------------------------------------------------------------------------------

for direction in ("push", "pull", "auto"):
    part_query(f"bfs_levels_{direction}", w(G45_SQL, BFS_SQL) + "SELECT id, level FROM bfs")(lambda g, how=direction: bfs.levels(g, direction=how))
query("bfs_levels_dense", w(GALL_SQL, BFS_SQL.replace("< 63", "< 8")) + "SELECT id, level FROM bfs")(lambda s, d: bfs.levels(G(s, d, None).store()))


@part_query("bfs_level_stats", w(G45_SQL, BFS_SQL, DEG_SQL) + "SELECT level, count(*) AS vertices, CAST(sum(deg) AS BIGINT) AS edges FROM bfs JOIN d USING (id) GROUP BY 1")
def bfs_level_stats(g: Graph) -> DataFrame:
    return bfs.level_stats(g, bfs.levels(g))


@part_query("bfs_level_prefix_sum", w(G45_SQL, BFS_SQL, 's AS (SELECT level, count(*) AS vertices FROM bfs GROUP BY 1)') + 'SELECT level, vertices, CAST(coalesce(sum(vertices) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start" FROM s')
def _(g):
    return bfs.level_offsets(bfs.levels(g).groupBy("level").agg(F.count("*").alias("vertices")))


@part_query("bfs_unreached", w(G45_SQL, BFS_SQL) + "SELECT DISTINCT src AS id FROM e WHERE src NOT IN (SELECT id FROM bfs)")
def _(g):
    return bfs.unreached(g, bfs.levels(g))


@part_query("bfs_trace_replay", w(G45_SQL, BFS_SQL) + "SELECT a.level, count(*) AS scanned, count(*) FILTER (WHERE b.level > a.level + 1) AS deeper FROM e JOIN bfs a ON a.id = e.src JOIN bfs b ON b.id = e.dst GROUP BY 1")
def _(g):
    return bfs.replay(g, bfs.levels(g))


@part_query("bfs_level_changes", w(G45_SQL, BFS_SQL) + "SELECT id, level, coalesce(lag(level) OVER (ORDER BY level, id) <> level, true) AS changed FROM bfs")
def _(g):
    return rel.level_changes(bfs.levels(g), "id", "level")


part_query("cc_labels", w(G45_SQL, CC_SQL) + "SELECT id, component FROM cc")(lambda g: components.component_labels(g))
part_query("cc_sizes", w(G45_SQL, CC_SQL) + "SELECT component, count(*) AS size FROM cc GROUP BY 1")(lambda g: components.component_sizes(components.component_labels(g)))
part_query("cc_pointer_jump", w(G45_SQL, CC_SQL) + "SELECT id, component FROM cc")(lambda g: components.label_rounds(g))
part_query("bc_sigma", w(G45_SQL, BFS_SQL, PATHS_SQL) + "SELECT id, level, sigma FROM sg JOIN bfs USING (id)")(lambda g: bc.sigma(g))
part_query("bc_sigma_by_level", w(G45_SQL, BFS_SQL, PATHS_SQL) + "SELECT level, count(*) AS vertices, CAST(sum(sigma) AS BIGINT) AS sigma FROM sg JOIN bfs USING (id) GROUP BY 1")(lambda g: bc.sigma(g).groupBy("level").agg(F.count("*").alias("vertices"), F.sum("sigma").cast("long").alias("sigma")))
BC_SQL = w(G45_SQL, BFS_SQL, PATHS_SQL, "x AS (SELECT p.id AS ending, unnest(p.path) AS v FROM p)", "dl AS (SELECT v, sum(1.0 / sigma) AS delta FROM x JOIN sg ON sg.id = x.ending WHERE v <> ending GROUP BY 1)") + "SELECT bfs.id, level, sigma, round(CAST(coalesce(delta, 0) AS DOUBLE), 6) AS delta, round(CAST(CASE WHEN level = 0 THEN 0 ELSE coalesce(delta, 0) END AS DOUBLE), 6) AS total FROM bfs JOIN sg USING (id) LEFT JOIN dl ON dl.v = bfs.id"
part_query("bc_delta", BC_SQL)(lambda g: bc.betweenness(g).select("id", "level", "sigma", r6("delta").alias("delta"), r6("total").alias("total")))

# --- triangles and traces ------------------------------------------------------------------------------------------------------

part_query("tri_edge_counts", w(G45_SQL, TRI_SQL) + "SELECT src, dst, triangles FROM tri")(lambda g: tri.edge_triangles(g))
query("tri_edge_counts_dense", w(GALL_SQL, TRI_SQL) + "SELECT src, dst, triangles FROM tri")(lambda s, d: tri.edge_triangles(G(s, d, None)))
part_query("tri_edge_intersections", w(G45_SQL, TRI_SQL, DEG_SQL) + "SELECT src, dst, triangles, a.deg + b.deg AS intersect_ops FROM tri JOIN d a ON a.id = src JOIN d b ON b.id = dst")(lambda g: tri.edge_intersections(g))


@query("tri_total", w(GALL_SQL) + "SELECT CAST(count(*) AS BIGINT) AS directed_sum, CAST(count(*) // 6 AS BIGINT) AS triangles FROM e JOIN e x ON x.src = e.src JOIN e y ON y.src = e.dst AND y.dst = x.dst")
def tri_total(spark, sf_dir):
    n = tri.triangle_count(G(spark, sf_dir, None))
    return n.select((F.col("triangles") * 6).alias("directed_sum"), "triangles")


query("tri_bipartite_total", w(BIP_SQL) + "SELECT count(*) AS triangles FROM e JOIN e x ON x.src = e.src JOIN e y ON y.src = e.dst AND y.dst = x.dst")(lambda s, d: tri.triangle_count(fx.trade_graph(s, d)))
part_query("tri_vertex_counts", w(G45_SQL, VTRI_SQL) + "SELECT id, deg, triangles FROM vt")(lambda g: tri.vertex_triangles(g))
CLUSTER = "SELECT id, deg, triangles, round(CASE WHEN deg > 1 THEN triangles / CAST({} AS DOUBLE) ELSE 0 END, 6) AS cc FROM vt"
part_query("tri_clustering_local", w(G45_SQL, VTRI_SQL) + CLUSTER.format("deg * (deg - 1)"))(lambda g: tri.clustering(tri.vertex_triangles(g)).withColumn("cc", r6("cc")))
part_query("tri_clustering_legacy", w(G45_SQL, VTRI_SQL) + CLUSTER.format("deg * deg - 1"))(lambda g: tri.clustering(tri.vertex_triangles(g), legacy=True).withColumn("cc", r6("cc")))
part_query("tri_clustering_mean", w(G45_SQL, VTRI_SQL) + "SELECT round(sum(CASE WHEN deg > 1 THEN triangles / CAST(deg * (deg - 1) AS DOUBLE) ELSE 0 END) / count(*), 6) AS mean_cc FROM vt")(lambda g: tri.mean_clustering(tri.clustering(tri.vertex_triangles(g))).select(r6("mean_cc").alias("mean_cc")))
query("tri_intersect_ops", w(GALL_SQL, DEG_SQL) + "SELECT CAST(sum(2 * deg * deg) AS BIGINT) AS intersect_ops FROM d")(lambda s, d: tri.intersect_ops(G(s, d, None)))
part_query("merge_steps", w(G45_SQL, ADJ_SQL, MERGE_SQL) + "SELECT src, dst, CAST(CASE WHEN lo <= hi THEN len(list_filter(a, lambda x: x <= hi)) + len(list_filter(b, lambda x: x <= hi)) ELSE 0 END AS BIGINT) AS steps FROM ab")(lambda g: tri.merge_steps(g))
part_query("merge_trace", w(G45_SQL, ADJ_SQL, MERGE_SQL, TRACE_SQL) + "SELECT src, dst, step, side, addr FROM trace")(lambda g: tri.merge_trace(g))

N = 1000
TRACES = {
    "linear": f"t AS (SELECT i AS addr FROM range({N}) x(i))",
    "random": f"t AS (SELECT ((i * 1103515245 + 12345) % 2147483648) % {N} AS addr FROM range({N}) x(i))",
    "mix": f"t AS (SELECT addr FROM trace ORDER BY src, dst, step LIMIT {N})",
}
OPS = {  # c visits of cell i, n trace length, b branch value
    "c": ("{n}", "CASE WHEN i <= {b} THEN c ELSE 0 END", "CASE WHEN i = {b} THEN c ELSE 0 END", "CASE WHEN i <= {b} THEN 2 * c ELSE c END", ">="),
    "java": ("1", "c", "1", "c + 2", ">="),
    "python": ("{h}", "c", "CASE WHEN i = 0 THEN c ELSE 0 END", "CASE WHEN i = 0 THEN 3 * c ELSE c END", ">"),
}


def scatter_sql(kind: str, dialect: str) -> str:
    var, geq, eq, three, cmp = (x.format(n=N, b=N // 2, h=N // 2) for x in OPS[dialect])
    rows = {"MEM_ONLY": "0", "INC": "c", "ADD_1M": "1000000 * c", "ADD_VAR": f"{var} * c", "COND_GEQ": geq, "COND_EQ": eq, "COND_3": three, "BRANCH": f"CASE WHEN i {cmp} {N // 2} THEN {N // 2} * c ELSE c END"}
    ctes = [G45_SQL, ADJ_SQL, MERGE_SQL, TRACE_SQL] if kind == "mix" else []
    return w(*ctes, TRACES[kind], "n AS (SELECT addr AS i, count(*) AS c FROM t GROUP BY 1)") + " UNION ALL ".join(f"SELECT CAST(i AS BIGINT) AS addr, '{op}' AS op, CAST({x} AS BIGINT) AS value FROM n" for op, x in rows.items())


for dialect in traces.DIALECTS:
    query(f"trace_linear_scatter_{dialect}", scatter_sql("linear", dialect))(lambda s, d, x=dialect: traces.scatter(traces.linear(s, N), N, x, N // 2))
    query(f"trace_random_scatter_{dialect}", scatter_sql("random", dialect))(lambda s, d, x=dialect: traces.scatter(traces.random(s, N), N, x, N // 2))
    part_query(f"trace_mix_scatter_{dialect}", scatter_sql("mix", dialect))(lambda g, x=dialect: traces.scatter(traces.mix(tri.merge_trace_start(g, N), N), N, x, N // 2))

# --- measurement frames --------------------------------------------------------------------------------------------------------

P = fx.perf
base = lambda: F.col("implementation") == "N"
CELL = ["algorithm", "graph", "iteration"]
COUNTERS = ["instructions", "mispredictions", "branches"]
K = ", ".join(PERF_KEYS)

query("perf_cells", w(PERF_SQL) + "SELECT * FROM perf")(P)


@query("perf_scan_union", w(PERF_SQL) + "SELECT algorithm, implementation, graph, iteration, \"time\", instructions, CASE WHEN algorithm = 'F' THEN 0 ELSE mispredictions END AS mispredictions, CASE WHEN algorithm = 'O' THEN 0 ELSE branches END AS branches FROM perf")
def _(spark, sf_dir):
    p = P(spark, sf_dir).drop("vertices", "edges")
    return union_fill([p.where("algorithm = 'F'").drop("mispredictions"), p.where("algorithm = 'O'").drop("branches")])


@query("perf_union_fill", w(PERF_SQL, EVT_SQL) + 'SELECT implementation, graph, iteration, "time", edges, branches, vertices FROM perf UNION ALL SELECT implementation, graph, iteration, "time", edges, 0, 0 FROM evt')
def _(spark, sf_dir):
    return union_fill([P(spark, sf_dir).select("implementation", "graph", "iteration", "time", "edges", "branches", "vertices"), fx.event_log(spark, sf_dir)])


query("perf_filter_in", w(PERF_SQL) + "SELECT * FROM perf WHERE algorithm = 'F' AND implementation IN ('A', 'N') AND graph <> 'BUILDING' AND iteration <> 0")(lambda s, d: P(s, d).where((F.col("algorithm") == "F") & F.col("implementation").isin("A", "N") & (F.col("graph") != "BUILDING") & (F.col("iteration") != 0)))
SUMS = ", ".join([f'CAST(sum({c}) AS BIGINT) AS {c}' for c in PERF_VALUES[1:]])
TOT_SQL = f'tot AS (SELECT {K}, CAST(max(iteration) + 1 AS BIGINT) AS iteration, round(sum("time"), 2) AS "time", {SUMS} FROM perf GROUP BY {K})'


def perf_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rel.totals(P(spark, sf_dir), PERF_KEYS, PERF_VALUES)
    return t.select(*PERF_KEYS, F.col("iteration").cast("long"), F.round("time", 2).alias("time"), *[F.col(c).cast("long").alias(c) for c in PERF_VALUES[1:]])


query("perf_totals", w(PERF_SQL, TOT_SQL) + "SELECT * FROM tot")(perf_totals)
query("perf_min_sum_max", w(PERF_SQL) + f'SELECT {K}, ' + ", ".join(f'CAST({f}({c}) AS BIGINT) AS {c}_{f}' for c in COUNTERS for f in ("min", "sum", "max")) + f" FROM perf GROUP BY {K}")(lambda s, d: rel.min_sum_max(P(s, d), PERF_KEYS, COUNTERS))
query("perf_norm_self", w(PERF_SQL) + f"SELECT {K}, iteration, " + ", ".join(f"round(CAST({c} AS DOUBLE) / nullif(instructions, 0), 6) AS {c}" for c in ("mispredictions", "branches")) + " FROM perf")(lambda s, d: rel.normalise_self(P(s, d), ["mispredictions", "branches"], "instructions").select(*PERF_KEYS, "iteration", r6("mispredictions").alias("mispredictions"), r6("branches").alias("branches")))


@query("perf_norm_baseline", w(PERF_SQL) + f'SELECT p.algorithm, p.implementation, p.graph, p.iteration, round(p."time" / nullif(b."time", 0), 6) AS "time", round(CAST(p.branches AS DOUBLE) / nullif(b.branches, 0), 6) AS branches FROM perf p JOIN perf b ON b.implementation = \'N\' AND b.algorithm = p.algorithm AND b.graph = p.graph AND b.iteration = p.iteration')
def _(spark, sf_dir):
    return rel.normalise(P(spark, sf_dir), CELL, ["time", "branches"], base()).select(*PERF_KEYS, "iteration", r6("time").alias("time"), r6("branches").alias("branches"))


@query("perf_norm_join", w(PERF_SQL) + 'SELECT p.algorithm, p.implementation, p.graph, p.iteration, round(p."time" / nullif(b.m, 0), 6) AS "time" FROM perf p JOIN (SELECT algorithm, graph, avg("time") AS m FROM perf GROUP BY 1, 2) b ON b.algorithm = p.algorithm AND b.graph = p.graph')
def _(spark, sf_dir):
    p = P(spark, sf_dir)
    norm = p.groupBy("algorithm", "graph").agg(F.avg("time").alias("time"))
    return rel.normalise_join(p, norm, ["algorithm", "graph"], ["time"]).select(*PERF_KEYS, "iteration", r6("time").alias("time"))


SPEED_SQL = "sp AS (SELECT t.algorithm, t.implementation, t.graph, b.\"time\" / nullif(t.\"time\", 0) AS speedup FROM tot t JOIN tot b ON b.implementation = 'N' AND b.algorithm = t.algorithm AND b.graph = t.graph)"


def perf_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.speedup(perf_totals(spark, sf_dir), ["algorithm", "graph"], "time", base()).select(*PERF_KEYS, "speedup")


query("perf_speedup", w(PERF_SQL, TOT_SQL, SPEED_SQL) + f"SELECT {K}, round(speedup, 6) AS speedup, printf('%.2fx', speedup) AS label FROM sp")(lambda s, d: perf_speedup(s, d).select(*PERF_KEYS, r6("speedup").alias("speedup"), fmt.times_label(F.col("speedup")).alias("label")))
query("perf_ratio_summary", w(PERF_SQL, TOT_SQL, SPEED_SQL) + "SELECT algorithm, implementation, round(min(speedup), 6) AS low, round(avg(speedup), 6) AS mean, round(max(speedup), 6) AS high FROM sp WHERE implementation <> 'N' GROUP BY 1, 2")(lambda s, d: perf_speedup(s, d).where(~base()).groupBy("algorithm", "implementation").agg(r6(F.min("speedup")).alias("low"), r6(F.avg("speedup")).alias("mean"), r6(F.max("speedup")).alias("high")))
CUM_SQL = f'cum AS (SELECT {K}, iteration, round(sum("time") OVER x, 2) AS "time", CAST(sum(mispredictions) OVER x AS BIGINT) AS mispredictions, CAST(sum(branches) OVER x AS BIGINT) AS branches FROM perf WINDOW x AS (PARTITION BY {K} ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))'


def perf_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.cumulative(P(spark, sf_dir), PERF_KEYS, "iteration", ["time", "mispredictions", "branches"]).select(*PERF_KEYS, "iteration", F.round("time", 2).alias("time"), "mispredictions", "branches")


query("perf_cumulative", w(PERF_SQL, CUM_SQL) + "SELECT * FROM cum")(perf_cumulative)
query("perf_cumulative_normalised", w(PERF_SQL, CUM_SQL) + f"SELECT {K}, iteration, round(\"time\" / nullif(max(CASE WHEN implementation = 'N' THEN \"time\" END) OVER (PARTITION BY algorithm, graph), 0), 6) AS \"time\" FROM cum")(lambda s, d: rel.normalise(perf_cumulative(s, d), ["algorithm", "graph"], ["time"], base()).select(*PERF_KEYS, "iteration", r6("time").alias("time")))
query("perf_per_edge", w(PERF_SQL) + f'SELECT {K}, iteration, ' + ", ".join(f'round(CAST("{c}" AS DOUBLE) / nullif(edges, 0), 6) AS "{c}"' for c in ["time", *COUNTERS]) + " FROM perf")(lambda s, d: rel.normalise_self(P(s, d), ["time", *COUNTERS], "edges").select(*PERF_KEYS, "iteration", *[r6(c).alias(c) for c in ["time", *COUNTERS]]))
LONG_SQL = "lng AS (" + " UNION ALL ".join(f"SELECT {K}, iteration, '{c}' AS key, CAST({c} AS DOUBLE) AS value FROM perf" for c in COUNTERS) + ")"


def perf_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.unpivot(P(spark, sf_dir), [*PERF_KEYS, "iteration"], COUNTERS)


query("perf_unpivot", w(PERF_SQL, LONG_SQL) + "SELECT * FROM lng")(perf_long)
query("perf_median_of_medians", w(PERF_SQL, LONG_SQL) + "SELECT implementation, key, median(m) AS median FROM (SELECT implementation, graph, key, median(value) AS m FROM lng GROUP BY 1, 2, 3) GROUP BY 1, 2")(lambda s, d: rel.median_of_medians(perf_long(s, d), ["implementation", "graph", "key"], ["implementation", "key"], "value"))
query("perf_mix_boxplot", w(PERF_SQL, LONG_SQL, "q AS (SELECT graph, key, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM lng GROUP BY 1, 2)") + "SELECT q.graph, q.key, q1, median, q3, min(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high FROM lng JOIN q ON q.graph = lng.graph AND q.key = lng.key GROUP BY 1, 2, 3, 4, 5")(lambda s, d: rel.box_stats(perf_long(s, d), ["graph", "key"], "value"))
query("perf_mix_total", w(PERF_SQL, LONG_SQL) + "SELECT implementation, key, sum(value) AS total FROM lng GROUP BY 1, 2")(lambda s, d: perf_long(s, d).groupBy("implementation", "key").agg(F.sum("value").alias("total")))
query("perf_mispred_bounds", w(PERF_SQL) + f"SELECT {K}, round(CAST(sum(mispredictions) AS DOUBLE) / nullif(sum(vertices), 0), 6) AS per_vertex FROM perf GROUP BY {K}")(lambda s, d: rel.bounds(P(s, d), PERF_KEYS, "mispredictions", "vertices", "per_vertex").withColumn("per_vertex", r6("per_vertex")))
CORR = ["time", *COUNTERS]
corr = lambda x, y: f'round(nullif(corr(CAST("{x}" AS DOUBLE), CAST("{y}" AS DOUBLE)), CAST(\'NaN\' AS DOUBLE)), 6)'
query("perf_corr_matrix", w(PERF_SQL) + " UNION ALL ".join(f"SELECT '{x}' AS var_x, '{y}' AS var_y, {corr(x, y)} AS rho FROM perf" for x in CORR for y in CORR))(lambda s, d: rel.correlation_matrix(P(s, d), CORR).withColumn("rho", r6("rho")))
query("perf_corr_grouped", w(PERF_SQL) + f"SELECT {K}, " + ", ".join(f"{corr('time', c)} AS r_{c}" for c in COUNTERS) + f" FROM perf GROUP BY {K}")(lambda s, d: rel.correlations_with(P(s, d), PERF_KEYS, "time", COUNTERS).select(*PERF_KEYS, *[r6(f"r_{c}").alias(f"r_{c}") for c in COUNTERS]))
query("perf_having_min_iters", w(PERF_SQL, TOT_SQL) + "SELECT graph, min(iteration) AS min_iteration FROM tot GROUP BY 1 HAVING min(iteration) >= 7")(lambda s, d: rel.having_min(perf_totals(s, d), ["graph"], "iteration", 7))
query("perf_distinct_values", w(PERF_SQL, EVT_SQL) + "SELECT DISTINCT implementation FROM (SELECT implementation FROM perf UNION ALL SELECT implementation FROM evt)")(lambda s, d: P(s, d).select("implementation").unionByName(fx.event_log(s, d).select("implementation")).distinct())
query("perf_all_zero_columns", w(PERF_SQL) + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", coalesce(bool_and({x} = 0), true) AS all_zero FROM perf" for c, x in (("branches", "branches"), ("mispredictions", "mispredictions"), ("stalls", "0"))))(lambda s, d: rel.zero_columns(P(s, d).withColumn("stalls", F.lit(0)), ["branches", "mispredictions", "stalls"]))
query("perf_label_position", w(PERF_SQL) + f'SELECT {K}, max(iteration) AS label_x, max("time") AS label_y FROM perf GROUP BY {K}')(lambda s, d: rel.label_positions(P(s, d), PERF_KEYS, "iteration", "time"))
query("perf_wins_ratio", w(PERF_SQL) + "SELECT a.algorithm, count(*) FILTER (WHERE a.\"time\" < b.\"time\") AS wins, count(*) AS n, round(count(*) FILTER (WHERE a.\"time\" < b.\"time\") / CAST(count(*) AS DOUBLE), 6) AS ratio FROM perf a JOIN perf b ON b.implementation = 'N' AND a.implementation = 'A' AND b.algorithm = a.algorithm AND b.graph = a.graph AND b.iteration = a.iteration GROUP BY 1")(lambda s, d: rel.wins(P(s, d).groupBy(*CELL).agg(F.max(F.when(F.col("implementation") == "A", F.col("time"))).alias("a"), F.max(F.when(base(), F.col("time"))).alias("b")).where("a is not null and b is not null"), ["algorithm"], "a", "b").withColumn("ratio", r6("ratio")))
query("perf_head", w(PERF_SQL) + f"SELECT * FROM perf ORDER BY {K}, iteration LIMIT 12")(lambda s, d: rel.head(P(s, d), 12, [*PERF_KEYS, "iteration"]))
query("perf_sample", w(PERF_SQL) + "SELECT 20 AS n, true AS inside")(lambda s, d: rel.sample_rows(P(s, d), 20).join(P(s, d).select(*PERF_KEYS, "iteration"), [*PERF_KEYS, "iteration"], "left_semi").agg(F.count("*").cast("int").alias("n"), (F.count("*") > 0).alias("inside")))
query("perf_iterations_report", w(PERF_SQL, CUM_SQL, TOT_SQL, SPEED_SQL) + f"SELECT c.algorithm, c.implementation, c.graph, c.iteration, round(c.\"time\" / nullif(max(CASE WHEN c.implementation = 'N' THEN c.\"time\" END) OVER (PARTITION BY c.algorithm, c.graph), 0), 6) AS y, printf('%.2fx', sp.speedup) AS label FROM cum c JOIN sp USING ({K})")(lambda s, d: rel.normalise(perf_cumulative(s, d), ["algorithm", "graph"], ["time"], base()).join(perf_speedup(s, d), PERF_KEYS).select(*PERF_KEYS, "iteration", r6("time").alias("y"), fmt.times_label(F.col("speedup")).alias("label")))

# --- formatting ----------------------------------------------------------------------------------------------------------------

query("fmt_times", w(PERF_SQL, TOT_SQL) + f"SELECT {K}, printf('%.2fx', \"time\" / 1e6) AS label FROM tot")(lambda s, d: perf_totals(s, d).select(*PERF_KEYS, fmt.times_label(F.col("time") / 1e6).alias("label")))
query("fmt_sigfig", w(PERF_SQL, TOT_SQL) + f"SELECT {K}, CASE WHEN branches = 0 THEN '0.00' ELSE printf('%.' || CAST(greatest(2 - CAST(floor(log10(branches)) AS INTEGER), 0) AS VARCHAR) || 'f', round(branches * pow(10, 2 - floor(log10(branches)))) / pow(10, 2 - floor(log10(branches)))) END AS label FROM tot".replace("printf('%.' || CAST(greatest(2 - CAST(floor(log10(branches)) AS INTEGER), 0) AS VARCHAR) || 'f', ", "printf(CASE WHEN branches >= 100 THEN '%.0f' WHEN branches >= 10 THEN '%.1f' ELSE '%.2f' END, "))(lambda s, d: perf_totals(s, d).select(*PERF_KEYS, fmt.sigfig_label(F.col("branches"), 3).alias("label")))
UNITS_IN = lambda x, steps: "CASE " + " ".join(f"WHEN {x} >= {at} THEN CAST(CAST(round_even({x} / {at}, 0) AS BIGINT) AS VARCHAR) || ' {name}'" for at, name in steps) + f" ELSE CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR) || ' ' END"
SI_SQL = UNITS_IN('CAST("time" * f AS DOUBLE)', [("1e9", "G"), ("1e6", "M"), ("1e3", "K"), ("1e0", ""), ("1e-2", "c"), ("1e-3", "m"), ("1e-6", "u"), ("1e-9", "n"), ("1e-12", "p")])
query("fmt_si", w(PERF_SQL, TOT_SQL) + f"SELECT {K}, f, {SI_SQL} || 's' AS label FROM tot, (VALUES (1e0), (1e-5), (1e-9), (1e-11), (1e-14), (-1e0)) x(f)")(lambda s, d: perf_totals(s, d).withColumn("f", F.explode(F.array(*[F.lit(x) for x in (1e0, 1e-5, 1e-9, 1e-11, 1e-14, -1e0)]))).select(*PERF_KEYS, "f", fmt.si(F.col("time") * F.col("f"), "s").alias("label")))
IEC_SQL = UNITS_IN("(instructions * CAST(f AS DOUBLE))", [("1073741824", "Gi"), ("1048576", "Mi"), ("1024", "Ki")])
query("fmt_iec", w(PERF_SQL, TOT_SQL) + f"SELECT {K}, f, {IEC_SQL} || 'B' AS label FROM tot, (VALUES (1), (300), (-1)) x(f)")(lambda s, d: perf_totals(s, d).withColumn("f", F.explode(F.array(F.lit(1), F.lit(300), F.lit(-1)))).select(*PERF_KEYS, "f", fmt.iec(F.col("instructions") * F.col("f"), "B").alias("label")))
query("key_encode_decode", w(PERF_SQL) + f"SELECT DISTINCT 'x--' || algorithm || '--' || implementation || '--' || graph AS model_key, 'x' AS architecture, {K} FROM perf")(lambda s, d: P(s, d).select(keys.encode(F.lit("x"), *[F.col(k) for k in PERF_KEYS]).alias("model_key")).distinct().select("model_key", *keys.decode(F.col("model_key"))))

# --- models --------------------------------------------------------------------------------------------------------------------

T, M, B = 'CAST("time" AS DOUBLE)', "CAST(mispredictions AS DOUBLE)", "CAST(branches AS DOUBLE)"
AI = ["algorithm", "implementation"]


@query("fit_ols1", w(PERF_SQL) + f"SELECT algorithm, implementation, round(regr_intercept({T}, {B}), 2) AS intercept, round(regr_slope({T}, {B}), 3) AS slope FROM perf GROUP BY 1, 2")
def _(spark, sf_dir):
    p = P(spark, sf_dir)
    c = models.fit(p, AI, "time", ["branches"], intercept=True).coefficients(spark, p.schema)
    return c.groupBy(*AI).agg(F.round(F.max(F.when(F.col("term") == models.INTERCEPT, F.col("coef"))), 2).alias("intercept"), F.round(F.max(F.when(F.col("term") == "branches", F.col("coef"))), 3).alias("slope"))


@query("fit_ols2", w(PERF_SQL, f"s AS (SELECT algorithm, implementation, sum({M}*{M}) AS mm, sum({M}*{B}) AS mb, sum({B}*{B}) AS bb, sum({M}*{T}) AS mt, sum({B}*{T}) AS bt FROM perf GROUP BY 1, 2)") + "SELECT algorithm, implementation, round((mt * bb - bt * mb) / (mm * bb - mb * mb), 2) AS mispredictions, round((bt * mm - mt * mb) / (mm * bb - mb * mb), 2) AS branches FROM s")
def _(spark, sf_dir):
    p = P(spark, sf_dir)
    c = models.fit(p, AI, "time", ["mispredictions", "branches"]).coefficients(spark, p.schema)
    return c.groupBy(*AI).pivot("term", ["mispredictions", "branches"]).agg(F.round(F.first("coef"), 2))


def _fit(**how):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = P(spark, sf_dir)
        return models.fit(p, AI, "time", [*COUNTERS, "vertices"], **how).coefficients(spark, p.schema).withColumn("coef", F.round("coef", 4))

    return run


query("fit_nnls")(_fit(nonneg=True))
query("fit_l1")(_fit(penalty=1e6))


@query("fit_predict_contrib", w(PERF_SQL, TOT_SQL, f"f AS (SELECT algorithm, implementation, sum({B} * {T}) / sum({B} * {B}) AS k FROM perf GROUP BY 1, 2)") + f'SELECT {K}, round(k * branches, 2) AS predicted, round("time", 2) AS "true" FROM tot JOIN f USING (algorithm, implementation)')
def _(spark, sf_dir):
    m = models.fit(P(spark, sf_dir), AI, "time", ["branches"])
    return models.predict(perf_totals(spark, sf_dir), m).select(*PERF_KEYS, F.round("predicted", 2).alias("predicted"), F.round("true", 2).alias("true"))


@query("fit_r2", w(PERF_SQL) + f"SELECT algorithm, implementation, round(regr_avgy({T}, {B}), 2) AS mu_obs, round(regr_r2({T}, {B}), 5) AS r_sq FROM perf GROUP BY 1, 2")
def _(spark, sf_dir):
    p = P(spark, sf_dir)
    return models.fit(p, AI, "time", ["branches"], intercept=True).diagnostics(spark, p.schema).select(*AI, F.round("mu_obs", 2).alias("mu_obs"), F.round("r_sq", 5).alias("r_sq"))


@query("fit_mean_rel_err", w(PERF_SQL, TOT_SQL, f"f AS (SELECT algorithm, implementation, sum({B} * {T}) / sum({B} * {B}) AS k FROM perf GROUP BY 1, 2)") + 'SELECT algorithm, implementation, round(avg(abs(k * branches - "time") / nullif("time", 0)), 6) AS mean_rel_err FROM tot JOIN f USING (algorithm, implementation) GROUP BY 1, 2')
def _(spark, sf_dir):
    m = models.fit(P(spark, sf_dir), AI, "time", ["branches"])
    return rel.mean_relative_error(models.predict(perf_totals(spark, sf_dir), m), AI, "predicted", "true").withColumn("mean_rel_err", r6("mean_rel_err"))
