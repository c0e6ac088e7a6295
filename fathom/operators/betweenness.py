"""Single-source betweenness: path counts forward, dependencies backward (Brandes)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.bfs import Rounds
from fathom.operators.graph import Graph, small
from fathom.plans.staging import Workspace


def _empty(graph: Graph) -> DataFrame:
    return graph.edges.sparkSession.createDataFrame([], "id long, level long, sigma long, delta double, total double")


def sigma_levels(graph: Graph, root: int | None = None) -> tuple[Rounds, Rounds] | None:
    """(id, sigma) by level, and from level 1 on the edges (id, src) by which shortest paths come from the level before.

    Sigma is exact in 64 bits and raises on overflow.  None for a graph without vertices.
    """
    root = graph.root() if root is None else root
    if root is None:
        return None
    edges, spark = graph.store().edges, graph.edges.sparkSession
    rounds, steps = Rounds(spark), Rounds(spark)
    now, n = rounds.add(spark.range(root, root + 1).withColumn("sigma", F.lit(1).cast("long")))
    seen: list[tuple[DataFrame, int]] = []
    while n:
        seen = [*seen[-1:], (now, n)]
        reach = edges.join(small(now.withColumnRenamed("id", "src"), n), "src").select(F.col("dst").alias("id"), "src", "sigma")
        for old, m in seen:
            reach = reach.join(small(old.select("id"), m), "id", "left_anti")
        found, k = steps.add(reach)
        if not k:
            break
        now, n = rounds.add(found.groupBy("id").agg(F.sum("sigma").cast("long").alias("sigma")))
    return rounds, steps


def sigma(graph: Graph, root: int | None = None) -> DataFrame:
    """(id, level, sigma)."""
    found = sigma_levels(graph, root)
    return found[0].table() if found else _empty(graph).select("id", "level", "sigma")


def betweenness(graph: Graph, root: int | None = None) -> DataFrame:
    """(id, level, sigma, delta, total): ``total`` is delta without the root's own.

    On the way back only the edges of shortest paths are read, which the way forward has written level by level.
    """
    found = sigma_levels(graph, root)
    if not found:
        return _empty(graph)
    rounds, steps = found
    space, share = Workspace(graph.edges.sparkSession), None
    last = len(rounds.sizes) - 1
    for d in range(last, -1, -1):
        here, n = rounds.level(d), rounds.sizes[d]
        if share is None:
            done = here.withColumn("delta", F.lit(0.0))
        else:
            # step d leads from level d to level d + 1, and holds the sigma of where it comes from
            paths = steps.level(d).join(small(share, rounds.sizes[d + 1]), "id")
            done = here.join(paths.groupBy(F.col("src").alias("id")).agg(F.sum("share").alias("share")), "id", "left").select("id", "sigma", (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta"))
        done.withColumn("total", F.col("delta") if d else F.lit(0.0)).write.parquet(f"{space.root}/delta/level={d}")
        back = graph.edges.sparkSession.read.schema("id long, sigma long, delta double, total double").parquet(f"{space.root}/delta/level={d}")
        share = back.select("id", ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
    out = graph.edges.sparkSession.read.schema("id long, sigma long, delta double, total double, level long").parquet(f"{space.root}/delta")
    return out.select("id", "level", "sigma", "delta", "total")


def differences(a: DataFrame, b: DataFrame, exact: list[str], close: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows on which two results keyed by ``id`` disagree; ``close`` columns are compared with a relative tolerance."""
    x, y = a.select("id", *[F.col(c).alias(f"{c}_a") for c in exact + close]), b.select("id", *[F.col(c).alias(f"{c}_b") for c in exact + close])
    bad = reduce(lambda p, q: p | q, [~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in exact], F.lit(False))
    for c in close:
        p, q = F.col(f"{c}_a"), F.col(f"{c}_b")
        bad = bad | p.isNull() | q.isNull() | (F.abs(p - q) > tolerance * F.greatest(F.abs(p), F.abs(q), F.lit(1.0)))
    return x.join(y, "id", "full").where(bad)
