"""Queries that write the driver's tables in every file form and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import bfs
from fathom.operators import triangles as tri
from fathom.operators.graph import Graph

from fathom.plans.catalog import G, P, TOT_SQL, perf_totals, query, w
from fathom.plans.fixtures import BFS_SQL, DEG_SQL, GALL_SQL, PERF_SQL, TRI_SQL, table
from fathom.plans.staging import Workspace
from fathom.sources import adjacency, perflog
from fathom.sources.catalogue import GRAPHS, graph_catalogue

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def folder(spark: SparkSession) -> str:
    return Workspace(spark).root


def highest(spark: SparkSession, sf_dir: str) -> int:
    """Vertices of the numbered parts: the format counts from 1, part keys from 0."""
    return (table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 0) + 1


def numbered(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(G(spark, sf_dir, None).edges.select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst")))


# --- adjacency text ------------------------------------------------------------------------------------------------------------


@query("scan_adjacency", w(GALL_SQL) + "SELECT src, dst FROM e")
def _(spark, sf_dir):
    path = folder(spark) + "/parts.graph"
    adjacency.write_adjacency(numbered(spark, sf_dir), highest(spark, sf_dir), path)
    return adjacency.read_graph(spark, path).edges.select((F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst"))


@query("scan_adjacency_vertices", w(GALL_SQL, DEG_SQL) + "SELECT i AS id, coalesce(deg, 0) AS deg FROM range(0, (SELECT max(p_partkey) + 1 FROM part)) x(i) LEFT JOIN d ON d.id = i")
def _(spark, sf_dir):
    path = folder(spark) + "/parts.graph"
    adjacency.write_adjacency(numbered(spark, sf_dir), highest(spark, sf_dir), path)
    return adjacency.read_graph(spark, path).degrees().withColumn("id", F.col("id") - 1)


query("sink_adjacency_lines", w(GALL_SQL, "n AS (SELECT max(p_partkey) + 1 AS n FROM part)", "a AS (SELECT src + 1 AS id, string_agg(CAST(dst + 1 AS VARCHAR), ' ' ORDER BY dst) AS line FROM e GROUP BY 1)") + "SELECT CAST(0 AS BIGINT) AS id, n || ' ' || (SELECT count(*) // 2 FROM e) || ' 0' AS line FROM n UNION ALL SELECT i, coalesce(line, '') FROM range(1, (SELECT n + 1 FROM n)) x(i) LEFT JOIN a ON a.id = i")(
    lambda s, d: adjacency.adjacency_lines(numbered(s, d), highest(s, d))
)
query("graph_catalogue", "SELECT collection, graph, '/data/' || collection || '/' || graph || '.graph' AS path FROM (VALUES " + ", ".join(f"('{c}', '{g}')" for g, c in GRAPHS.items()) + ") x(collection, graph)")(lambda s, d: graph_catalogue(s, "/data/"))

# --- measurement logs ----------------------------------------------------------------------------------------------------------

#: A log's column, and what it is in the measurement frame.
LOG = {"Algorithm": "algorithm", "Implementation": "implementation", "Iteration": "iteration", "Time": '"time"', "Cycles": "instructions * 3", "Instructions": "instructions", "Loads.Retired": "vertices", "Stores.Retired": "edges", "Branches": "branches", "Mispredictions": "mispredictions", "Vertices": "vertices", "Edges": "edges"}
READ = {k.replace(".", "_"): v for k, v in LOG.items()}


def log_frame(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    return P(spark, sf_dir).select("graph", *[F.expr(LOG[n].replace('"', "`")).alias(n) for n in names])


def write_all(df: DataFrame, root: str, arch: str, header: bool = True, graphs: tuple[str, ...] = SEGMENTS, misspelt: bool = False) -> None:
    """``root/<arch>-<algorithm>/<graph>.log`` for both algorithms."""
    df = df.persist()
    for algorithm in ("F", "O"):
        for g in graphs:
            one = df.where((F.col("graph") == g) & F.col("Algorithm").startswith(algorithm)).drop("graph")
            one = one.withColumnRenamed("Iteration", "Itetarion") if misspelt else one
            path = f"{root}/{arch}-{algorithm}/{g}.log"
            if header:
                perflog.write_log(one, path, order=("Algorithm", "Implementation", "Itetarion" if misspelt else "Iteration"))
            else:
                one.coalesce(1).write.csv(path, sep="\t")
    df.unpersist()


def read_sql(names: list[str], arch: str = "hsw", where: str = "true") -> str:
    cols = ", ".join(f"CAST({READ[n]} AS DOUBLE){' * 1e-9' if n == 'Time' and 'Cycles' in names else ''} AS {n}" for n in names if n not in ("Algorithm", "Implementation", "Iteration"))
    return w(PERF_SQL) + f"SELECT '{arch}' AS Architecture, algorithm AS Algorithm, implementation AS Implementation, graph AS Graph, iteration AS Iteration, {cols} FROM perf WHERE {where}"


@query("scan_log", read_sql(list(READ), where="graph = 'BUILDING' AND algorithm = 'F'"))
def _(spark, sf_dir):
    root = folder(spark)
    write_all(log_frame(spark, sf_dir, list(LOG)), root, "hsw", graphs=("BUILDING",), misspelt=True)
    return perflog.read_log(spark, f"{root}/hsw-F/BUILDING.log", "hsw", "BUILDING")


@query("scan_logs_many", read_sql(list(READ)))
def _(spark, sf_dir):
    root = folder(spark)
    write_all(log_frame(spark, sf_dir, list(LOG)), root, "hsw")
    return perflog.read_logs(spark, root, ["hsw", "none"], ["F", "O"], [*SEGMENTS, "NOWHERE"])


NINE = perflog.HEADERLESS[9]


@query("scan_logs_headerless_9", read_sql(NINE, "old"))
def _(spark, sf_dir):
    root = folder(spark)
    write_all(log_frame(spark, sf_dir, NINE), root, "old", header=False)
    return perflog.read_logs(spark, root, ["old"], ["F", "O"], SEGMENTS)


@query("scan_logs_headerless_8", read_sql(NINE, "old"))
def _(spark, sf_dir):
    root = folder(spark)
    one_field = log_frame(spark, sf_dir, NINE).withColumn("Algorithm", F.concat_ws(" ", "Algorithm", "Implementation"))
    write_all(one_field.select("graph", *perflog.HEADERLESS[8]), root, "old", header=False)
    return perflog.read_logs(spark, root, ["old"], ["F", "O"], SEGMENTS)


SHORT_SQL = {"Comp": "algorithm", "Alg": "implementation", "Iters": "iteration", "Time": '"time"', "Cycles": "CAST(instructions * 3 AS DOUBLE)", "Insts": "CAST(instructions AS DOUBLE)", "Loads": "CAST(vertices AS DOUBLE)", "Stores": "CAST(edges AS DOUBLE)", "Brs": "CAST(branches AS DOUBLE)", "Mispreds": "CAST(mispredictions AS DOUBLE)", "Vs": "CAST(vertices AS DOUBLE)", "Es": "CAST(edges AS DOUBLE)"}


def short_sql(names: list[str], archs: list[str]) -> str:
    return w(PERF_SQL) + " UNION ALL ".join("SELECT " + ", ".join(f"{SHORT_SQL[n]} AS {n}" for n in names) + f", '{a}' AS Arch, graph AS Graph FROM perf" for a in archs)


@query("scan_shorts_extended", short_sql(perflog.EXTENDED, ["hsw"]))
def _(spark, sf_dir):
    root = folder(spark)
    write_all(log_frame(spark, sf_dir, list(LOG)), root, "hsw")
    return perflog.read_shorts(spark, root, ["hsw"], ["F", "O"], SEGMENTS)


@query("scan_shorts_mixed", short_sql(perflog.PLAIN, ["hsw", "old"]))
def _(spark, sf_dir):
    root = folder(spark)
    write_all(log_frame(spark, sf_dir, list(LOG)), root, "hsw")
    write_all(log_frame(spark, sf_dir, NINE), root, "old", header=False)
    return perflog.read_shorts(spark, root, ["hsw", "old"], ["F", "O"], SEGMENTS)


@query("scan_missing_log", "SELECT * FROM (VALUES ('hsw-F/BUILDING.log', true), ('hsw-F/NOWHERE.log', false)) x(file, found)")
def _(spark, sf_dir):
    root = folder(spark)
    write_all(log_frame(spark, sf_dir, NINE), root, "hsw", graphs=("BUILDING",))
    return spark.createDataFrame([(f, perflog.exists(spark, f"{root}/{f}")) for f in ("hsw-F/BUILDING.log", "hsw-F/NOWHERE.log")], "file string, found boolean")


@query("sink_log_header", "SELECT * FROM (VALUES (0, 'Algorithm'), (1, 'Iteration'), (2, 'Time'), (3, 'Branches'), (4, 'Instructions'), (5, 'Edges')) x(pos, name)")
def _(spark, sf_dir):
    names = perflog.header_columns({"Branches": True, "Stalls": False, "Instructions": True}, ["Algorithm", "Iteration", "Time"], ["Edges"])
    return spark.createDataFrame(list(enumerate(names)), "pos int, name string")


@query("scan_names", "SELECT * FROM (VALUES ('branches'), ('instructions'), ('edges')) x(name)")
def _(spark, sf_dir):
    path = folder(spark) + "/vars.txt"
    perflog.write_names(spark, ["branches", " instructions", "", "edges"], path)
    return spark.createDataFrame([(n,) for n in perflog.read_names(spark, path)], "name string")


# --- other rows ----------------------------------------------------------------------------------------------------------------

RESULT = ", ".join(["vertices AS nv", "edges AS ne", "instructions AS intersections", "mispredictions AS ba_wins", 'round("time" / 1e6, 3) AS time_bb', 'round("time" / 2e6, 3) AS time_ba', 'round("time" / 3e6, 3) AS time_bac', "0.5e0 AS ratio_ba", "0.25e0 AS ratio_bac"])
LANG_SQL = "CASE implementation WHEN 'A' THEN 'C' WHEN 'N' THEN 'Python' ELSE 'Java' END"


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.expr(LANG_SQL)
    return perf_totals(spark, sf_dir).select(F.concat("graph", F.lit("-"), "algorithm").alias("graph"), lang.alias("lang"), *[F.expr(x.replace('"', "`").replace(";", ",")) for x in RESULT.replace(", 3)", "; 3)").split(", ")])


@query("scan_results", w(PERF_SQL, TOT_SQL, f"r AS (SELECT graph || '-' || algorithm AS graph, {LANG_SQL} AS lang, {RESULT} FROM tot)") + "SELECT graph, lang, CAST(nv AS DOUBLE) AS nv, CAST(ne AS DOUBLE) AS ne, CAST(intersections AS DOUBLE) AS intersections, CAST(ba_wins AS DOUBLE) AS ba_wins, round(CASE WHEN lang = 'Python' THEN time_ba ELSE time_bb END, 4) AS time_bb, round(CASE WHEN lang = 'Python' THEN time_bb ELSE time_ba END, 4) AS time_ba, round(time_bac, 4) AS time_bac, CAST(ratio_ba AS DOUBLE) AS ratio_ba, CAST(ratio_bac AS DOUBLE) AS ratio_bac FROM r")
def _(spark, sf_dir):
    path = folder(spark) + "/results"
    perflog.result_lines(result_rows(spark, sf_dir)).write.text(path)
    read = perflog.read_results(spark, path)
    return read.withColumns({c: F.round(c, 4) for c in ("time_bb", "time_ba", "time_bac")})




@query("sink_synthetic_lines", w(PERF_SQL, TOT_SQL) + "SELECT printf('%10s, %8s, %.5f, %.5f, %.5f, %.5f, %.5f, %.5f, %.5f, %d', graph, implementation, CAST(iteration AS DOUBLE), CAST(mispredictions AS DOUBLE) / branches, CAST(vertices AS DOUBLE) / branches, 0.5e0, 0.25e0, 2e0, 1.5e0, branches) AS value FROM tot")
def _(spark, sf_dir):
    t, d = perf_totals(spark, sf_dir), lambda x: F.lit(x).cast("double")
    rows = t.select(F.col("graph").alias("trace"), F.col("implementation").alias("lang"), F.col("iteration").cast("double").alias("inc"), (F.col("mispredictions") / F.col("branches")).alias("add_1m"), (F.col("vertices") / F.col("branches")).alias("add_var"), d(0.5).alias("cond_eq"), d(0.25).alias("cond_geq"), d(2.0).alias("cond_3"), d(1.5).alias("branch"), F.col("branches").alias("length"))
    return perflog.synthetic_lines(rows)


LEVELS_SQL = (GALL_SQL, BFS_SQL.replace("< 63", "< 8"), DEG_SQL, "s AS (SELECT level, count(*) AS vertices, CAST(sum(deg) AS BIGINT) AS edges FROM bfs JOIN d USING (id) GROUP BY 1)")


def level_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G(spark, sf_dir, None).store()
    return bfs.level_stats(g, bfs.levels(g))


@query("sink_levels", w(*LEVELS_SQL) + "SELECT row_number() OVER (ORDER BY level) - 1 AS pos, level, vertices, edges FROM s")
def _(spark, sf_dir):
    path = folder(spark) + "/levels.tsv"
    perflog.write_log(level_rows(spark, sf_dir), path, order=("level",))
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("pos", "line")).where("pos > 0")
    part = F.split("line", "\t")
    return lines.select((F.col("pos") - 1).cast("long").alias("pos"), *[part[i].cast("long").alias(c) for i, c in enumerate(("level", "vertices", "edges"))])


@query("sink_phases", w(*LEVELS_SQL, "x AS (SELECT 'traversal' AS phase, level, vertices, level AS o, 0 AS p FROM s UNION ALL SELECT 'dependency', level, vertices, -level, 1 FROM s)") + "SELECT row_number() OVER (ORDER BY p, o) AS pos, phase || ',' || level || ',' || vertices AS line FROM x")
def _(spark, sf_dir):
    path = folder(spark) + "/phases.csv"
    s = level_rows(spark, sf_dir).select("level", "vertices")
    perflog.write_phases(perflog.union_tagged({"traversal": s, "dependency": s}, "phase").select("phase", "level", "vertices"), path)
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("pos", "line"))
    return lines.where("pos > 0").select(F.col("pos").cast("long"), "line")


@query("sink_edge_triangles", w(GALL_SQL, TRI_SQL) + "SELECT src, dst, triangles FROM tri")
def _(spark, sf_dir):
    """One row an edge as compressed CSV, in as many files as there are tasks."""
    path = folder(spark) + "/triangles.csv"
    tri.edge_triangles(G(spark, sf_dir, None)).write.csv(path, header=True, compression="gzip")
    return spark.read.csv(path, header=True, schema="src long, dst long, triangles long")


@query("bfs_measured", w(GALL_SQL, BFS_SQL.replace("< 63", "< 8")) + "SELECT level, count(*) AS vertices, true AS timed FROM bfs GROUP BY 1")
def _(spark, sf_dir):
    return bfs.frontiers(G(spark, sf_dir, None).store()).measured().select("level", "vertices", (F.col("nanoseconds") > 0).alias("timed"))
