"""Connected components; the label is the smallest vertex id of the component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.graph import BROADCAST_ROWS, Graph
from fathom.plans.staging import checkpoint, free_shuffles, trim_driver


def _mark(df: DataFrame, *cols: str) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*cols)), F.sum(F.hash(*cols).cast("long"))).first())


def star_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, component) for the ends of ``edges(src, dst)``, in either orientation, by alternating large-star and small-star steps.

    The number of rounds grows with the logarithm of the longest path, not with the diameter, and each step is one aggregation and one
    join on the edge list.  Loops only name a vertex.  Null ends are dropped.
    """
    src, dst = F.col("src").cast("long"), F.col("dst").cast("long")
    named = edges.where("src is not null and dst is not null")
    e = checkpoint(named.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct())
    alone = e.where("u = v").select(F.col("u").alias("id"))
    e, seen = e.where("u > v"), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        if (now := _mark(e, "u", "v")) == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    ids = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id")).unionByName(alone).distinct().join(ids, "id", "left_anti")
    return ids.unionByName(roots.select("id", F.col("id").alias("component")))


def component_labels(graph: Graph) -> DataFrame:
    """(id, component), isolated vertices included."""
    named = graph.edges.where("src > dst")
    if graph.isolated is not None:
        named = named.unionByName(graph.isolated.select(F.col("id").cast("long").alias("src"), F.col("id").cast("long").alias("dst")))
    return star_components(named)


def label_rounds(graph: Graph, jump: bool = True, max_rounds: int = 100_000) -> DataFrame:
    """The same labels by iterated neighbour minimum, with pointer jumping unless ``jump`` is false.

    A jump takes the least of what a label's holders have met and of its own vertex's label, so labels that meet become one in a round.
    Beyond BROADCAST_ROWS labels all joins are by shuffle, since a broadcast passes through the driver, and what a round leaves in the
    driver and on the disks goes before the next.
    """
    labels, edges = checkpoint(graph.vertices.withColumn("component", F.col("id"))), graph.edges if graph.stored else graph.edges.persist()
    large = labels.count() > BROADCAST_ROWS
    by = lambda df: df.hint("merge") if large else df
    seen = None
    try:
        for _ in range(max_rounds):
            near = edges.join(by(labels.withColumnRenamed("id", "dst")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
            labels = labels.join(by(near), "id", "left").select("id", "component", F.least("component", "m").alias("m"))
            if jump:
                own = labels.select(F.col("id").alias("component"), F.col("m").alias("far"))
                far = labels.select("component", F.col("m").alias("far")).unionByName(own).groupBy("component").agg(F.min("far").alias("far"))
                labels = labels.join(by(far), "component").withColumn("m", F.least("m", "far"))
            labels = checkpoint(labels.select("id", F.col("m").alias("component")))
            if (now := _mark(labels, "id", "component")) == seen:
                return labels
            seen = now
            if large:
                free_shuffles(labels.sparkSession)
                trim_driver(labels.sparkSession)
    finally:
        if not graph.stored:
            edges.unpersist()
    raise RuntimeError("components did not settle")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("size"))
