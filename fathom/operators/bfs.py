"""Breadth-first search as a driver loop over DataFrame joins.

In a symmetric graph the neighbours of level d lie on levels d-1, d and d+1, so a round needs only the last two frontiers, never the
visited set.  Each round writes its frontier once, as a part of one table; a metric observed on that write tells when to stop.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.operators.graph import Graph, small
from fathom.plans.staging import Workspace


class Rounds:
    """The frontiers of a search as one table by level in the shared folder, so that its plan does not grow with the levels."""

    def __init__(self, spark):
        self.spark, self.path, self.schema = spark, f"{Workspace(spark).root}/levels", None
        self.sizes: list[int] = []
        self.nanoseconds: list[int] = []

    def add(self, frontier: DataFrame) -> tuple[DataFrame, int]:
        """Write the next level; gives it as written, and its row count."""
        seen, path, began = Observation(), f"{self.path}/level={len(self.sizes)}", time.perf_counter_ns()
        frontier.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        self.schema = frontier.schema
        self.sizes.append(seen.get["n"])
        self.nanoseconds.append(time.perf_counter_ns() - began)
        return self.level(len(self.sizes) - 1), self.sizes[-1]

    def level(self, d: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/level={d}")

    def measured(self) -> DataFrame:
        """(level, vertices, nanoseconds): what each round found and took; one pass gives all counts."""
        rows = [(d, n, t) for d, (n, t) in enumerate(zip(self.sizes, self.nanoseconds, strict=True)) if n]
        return self.spark.createDataFrame(rows, "level long, vertices long, nanoseconds long")

    def table(self) -> DataFrame:
        """All levels, with a column ``level``."""
        found = self.spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in self.schema)}, level long").parquet(self.path)
        return found.select(self.schema.names[0], "level", *self.schema.names[1:])


def push(edges: DataFrame, frontier: DataFrame, n: int) -> DataFrame:
    """Top-down: expand the frontier along its edges."""
    return edges.join(small(frontier.withColumnRenamed("id", "src"), n), "src").select(F.col("dst").alias("id")).distinct()


def pull(edges: DataFrame, frontier: DataFrame, n: int) -> DataFrame:
    """Bottom-up: keep the vertices that have a neighbour on the frontier."""
    return edges.join(small(frontier.withColumnRenamed("id", "dst"), n), "dst", "left_semi").select(F.col("src").alias("id")).distinct()


def frontiers(graph: Graph, root: int | None = None, direction: str = "auto", max_rounds: int = 1_000_000) -> Rounds | None:
    """One level after the other; None for a graph without vertices.  ``auto`` pulls once a frontier holds over a tenth of all vertices.
    Raises after ``max_rounds`` rounds rather than give a part."""
    if direction not in ("push", "pull", "auto"):
        raise ValueError(f"unknown direction {direction!r}")
    root = graph.root() if root is None else root
    if root is None:
        return None
    graph = graph.store()
    spark, edges, rounds = graph.edges.sparkSession, graph.edges, Rounds(graph.edges.sparkSession)
    total = graph.vertices.count() if direction == "auto" else 0
    now, n = rounds.add(spark.range(root, root + 1))
    before = None
    while n:
        if len(rounds.sizes) > max_rounds:
            raise RuntimeError(f"the search has not ended after {max_rounds} rounds")
        step = pull if direction == "pull" or (direction == "auto" and 10 * n > total) else push
        fresh = step(edges, now, n).join(small(now, n), "id", "left_anti")
        if before is not None:
            fresh = fresh.join(small(*before), "id", "left_anti")
        before = (now, n)
        now, n = rounds.add(fresh)
    return rounds


def levels(graph: Graph, root: int | None = None, direction: str = "auto") -> DataFrame:
    """(id, level) of the reached vertices; an unreached vertex has no row (see ``unreached``)."""
    rounds = frontiers(graph, root, direction)
    return graph.edges.sparkSession.createDataFrame([], "id long, level long") if rounds is None else rounds.table()


def unreached(graph: Graph, reached: DataFrame) -> DataFrame:
    """Vertices without a level."""
    return graph.vertices.join(reached, "id", "left_anti")


def level_stats(graph: Graph, reached: DataFrame) -> DataFrame:
    """(level, vertices, edges): frontier sizes and traversed directed edges."""
    return reached.join(graph.degrees(), "id", "left").groupBy("level").agg(F.count("*").alias("vertices"), F.sum(F.coalesce("deg", F.lit(0))).cast("long").alias("edges"))


def level_offsets(stats: DataFrame) -> DataFrame:
    """Start position of each level in the visiting order (one row per level, so a single window is small)."""
    w = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    return stats.select("level", "vertices", F.coalesce(F.sum("vertices").over(w), F.lit(0)).cast("long").alias("start"))


def replay(graph: Graph, reached: DataFrame) -> DataFrame:
    """Read-only rescan of the recorded frontiers: per level, endpoints looked at and endpoints deeper than the next level (always 0)."""
    ends = graph.edges.join(reached.select(F.col("id").alias("src"), "level"), "src").join(reached.select(F.col("id").alias("dst"), F.col("level").alias("found")), "dst")
    return ends.groupBy("level").agg(F.count("*").alias("scanned"), F.count(F.when(F.col("found") > F.col("level") + 1, 1)).alias("deeper"))
