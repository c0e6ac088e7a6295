"""The driver's tables seen as graphs and measurement frames, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_graph(spark: SparkSession, sf_dir: str, quantity: int | None = 45) -> Graph:
    """Parts bought in one order (both lines of at least ``quantity``); an order has a handful of lines, so its pairs are few."""
    lines = table(spark, sf_dir, "lineitem")
    if quantity is not None:
        lines = lines.where(F.col("l_quantity") >= quantity)
    a = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("src"))
    b = a.withColumnRenamed("src", "dst")
    return Graph.from_pairs(a.join(b, "o").where("src < dst").select("src", "dst"))


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and suppliers (ids from 10^9) that meet in an order."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    pairs = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1_000_000_000).alias("dst"))
    return Graph.from_pairs(pairs)


PERF_KEYS = ["algorithm", "implementation", "graph"]
PERF_VALUES = ["time", "instructions", "mispredictions", "branches", "vertices", "edges"]


def perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measurement log in the canonical shape, from order lines."""
    lines, orders, customers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    keys = [F.col("l_linestatus").alias("algorithm"), F.col("l_returnflag").alias("implementation"), F.col("c_mktsegment").alias("graph"), (F.year("l_shipdate") - 1995).cast("long").alias("iteration")]
    return joined.groupBy(*keys).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("time"),
        F.sum("l_quantity").cast("long").alias("instructions"),
        F.count_if(F.col("l_discount") >= 0.05).alias("mispredictions"),
        F.count("*").alias("branches"),
        F.countDistinct("o_custkey").alias("vertices"),
        F.count("*").alias("edges"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second log with fewer columns, from events."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("implementation"), F.pmod("user_id", F.lit(5)).cast("string").alias("graph"), F.dayofmonth("ts").cast("long").alias("iteration")).agg(F.round(F.sum("value"), 4).alias("time"), F.count("*").alias("edges"))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


EDGES_SQL = """l AS (SELECT l_orderkey AS o, l_partkey AS p FROM lineitem {where}),
e AS (SELECT DISTINCT a.p AS src, b.p AS dst FROM l a JOIN l b ON a.o = b.o WHERE a.p <> b.p)"""
G45_SQL = EDGES_SQL.format(where="WHERE l_quantity >= 45")
GALL_SQL = EDGES_SQL.format(where="")
BIP_SQL = """h AS (SELECT DISTINCT o_custkey AS a, l_suppkey + 1000000000 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT a AS src, b AS dst FROM h UNION ALL SELECT b, a FROM h)"""
DEG_SQL = "d AS (SELECT src AS id, count(*) AS deg FROM e GROUP BY 1)"
ADJ_SQL = "adj AS (SELECT src AS id, list(dst ORDER BY dst) AS nbrs, count(*) AS deg FROM e GROUP BY 1)"
BFS_SQL = """w AS (SELECT min(src) AS id, CAST(0 AS BIGINT) AS level FROM e UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON w.id = e.src WHERE w.level < 63),
bfs AS (SELECT id, min(level) AS level FROM w GROUP BY 1)"""
CC_SQL = """r AS (SELECT src AS id, src AS seen FROM e UNION SELECT r.id, e.dst FROM r JOIN e ON r.seen = e.src),
cc AS (SELECT id, min(seen) AS component FROM r GROUP BY 1)"""
PATHS_SQL = """dag AS (SELECT e.src, e.dst FROM e JOIN bfs a ON a.id = e.src JOIN bfs b ON b.id = e.dst WHERE b.level = a.level + 1),
p AS (SELECT (SELECT min(src) FROM e) AS id, [(SELECT min(src) FROM e)] AS path UNION ALL SELECT dag.dst, list_append(p.path, dag.dst) FROM p JOIN dag ON dag.src = p.id),
sg AS (SELECT id, count(*) AS sigma FROM p GROUP BY 1)"""
TRI_SQL = """tri AS (SELECT e.src, e.dst, count(y.dst) AS triangles FROM e LEFT JOIN e x ON x.src = e.src LEFT JOIN e y ON y.src = e.dst AND y.dst = x.dst GROUP BY 1, 2)"""
VTRI_SQL = TRI_SQL + """, vt AS (SELECT src AS id, count(*) AS deg, CAST(sum(triangles) AS BIGINT) AS triangles FROM tri GROUP BY 1)"""
MERGE_SQL = """ab AS (SELECT e.src, e.dst, a.nbrs AS a, b.nbrs AS b, greatest(a.nbrs[1], b.nbrs[1]) AS lo, least(a.nbrs[-1], b.nbrs[-1]) AS hi FROM e JOIN adj a ON a.id = e.src JOIN adj b ON b.id = e.dst)"""
TRACE_SQL = """offs AS (SELECT id, nbrs, CAST(coalesce(sum(deg) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM adj),
pos AS (SELECT e.src AS node, e.dst AS v, o.off + row_number() OVER (PARTITION BY e.src ORDER BY e.dst) - 1 AS addr FROM e JOIN offs o ON o.id = e.src),
side AS (SELECT ab.src, ab.dst, 0 AS side, pos.v, pos.addr FROM ab JOIN pos ON pos.node = ab.src WHERE lo <= hi AND pos.v <= hi
 UNION ALL SELECT ab.src, ab.dst, 1, pos.v, pos.addr FROM ab JOIN pos ON pos.node = ab.dst WHERE lo <= hi AND pos.v <= hi),
trace AS (SELECT src, dst, row_number() OVER (PARTITION BY src, dst ORDER BY v, side) - 1 AS step, side, addr FROM side)"""
PERF_SQL = """perf AS (SELECT l_linestatus AS algorithm, l_returnflag AS implementation, c_mktsegment AS graph, CAST(year(l_shipdate) - 1995 AS BIGINT) AS iteration,
 round(sum(l_extendedprice), 2) AS "time", CAST(sum(l_quantity) AS BIGINT) AS instructions, count(*) FILTER (WHERE l_discount >= 0.05) AS mispredictions,
 count(*) AS branches, count(DISTINCT o_custkey) AS vertices, count(*) AS edges
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4)"""
EVT_SQL = """evt AS (SELECT event_type AS implementation, CAST(user_id % 5 AS VARCHAR) AS graph, CAST(day(ts) AS BIGINT) AS iteration, round(sum(value), 4) AS "time", count(*) AS edges FROM events GROUP BY 1, 2, 3)"""
