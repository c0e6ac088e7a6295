"""Adjacency text: a header ``n m [flags]``, then one line of neighbours per vertex; ids start at 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from fathom.operators.graph import Graph
from fathom.plans.staging import Workspace, free_shuffles


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, value) of the lines that are no comments, from 0 in each file.

    Files are read in blocks, by as many tasks.  A line's number is its place in its block and the count of lines in the blocks before;
    the lines are kept with their places, so that both are of one reading.
    """
    text = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("value"))
    lines = Workspace(spark).put("lines", text.where(~F.col("value").startswith("%")).withColumn("at", F.monotonically_increasing_id()))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    heads = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first")).withColumn("before", F.coalesce(before, F.lit(0)))
    return lines.join(F.broadcast(heads), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("number"), "value")


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) as listed, duplicates and loops included.

    A blank line is a vertex without neighbours; lines starting with ``%`` are comments and do not count.  Each file is a graph.
    """
    rows = numbered_lines(spark, path).where("number > 0").select(F.col("number").alias("src"), F.explode(F.split(F.trim("value"), "[ \t]+")).alias("dst"))
    return rows.where("dst <> ''").select("src", F.col("dst").try_cast("long").alias("dst")).where("dst is not null")


def read_header(spark: SparkSession, path: str) -> tuple[int, int]:
    """(n, m) of the first line that is no comment; further numbers are ignored."""
    first = spark.read.text(path).where(~F.col("value").startswith("%")).first()[0].split()
    return int(first[0]), int(first[1])


def read_graph(spark: SparkSession, path: str) -> Graph:
    """Canonical graph with all n declared vertices; raises when a neighbour id is out of range."""
    n, _ = read_header(spark, path)
    pairs = read_adjacency(spark, path)
    if bad := pairs.where((F.col("dst") < 1) | (F.col("dst") > n) | (F.col("src") > n)).first():
        raise ValueError(f"vertex out of range 1..{n}: {tuple(bad)}")
    return Graph.from_pairs(pairs, vertices=spark.range(1, n + 1))


def adjacency_lines(graph: Graph, n: int) -> DataFrame:
    """(id, line) for ids 0..n, where line 0 is the header ``n m 0``."""
    spark = graph.edges.sparkSession
    lists = Workspace(spark).put("lists", graph.adjacency())
    m = (lists.agg(F.sum("deg")).first()[0] or 0) // 2
    listed = lists.where(F.col("id").between(1, n)).select("id", F.array_join(F.col("nbrs").cast("array<string>"), " ").alias("line"))
    empty = spark.range(1, n + 1).join(lists.select("id"), "id", "left_anti").select("id", F.lit("").alias("line"))
    return spark.createDataFrame([(0, f"{n} {m} 0")], "id long, line string").unionByName(listed).unionByName(empty)


def write_adjacency(graph: Graph, n: int, path: str) -> None:
    """One ordered text file; the format has no parts."""
    lines = adjacency_lines(graph, n)
    free_shuffles(lines.sparkSession)
    lines.coalesce(1).sortWithinPartitions("id").select("line").write.mode("overwrite").text(path)
    free_shuffles(lines.sparkSession)
