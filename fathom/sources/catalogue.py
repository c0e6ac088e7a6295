"""Graphs by name and collection, and where their files are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Collection of each graph.
GRAPHS = {
    "astro-ph": "clustering",
    "caidaRouterLevel": "clustering",
    "cond-mat-2005": "clustering",
    "preferentialAttachment": "clustering",
    "smallworld": "clustering",
    "coAuthorsDBLP": "coauthor",
    "delaunay_n20": "delaunay",
    "finan512": "walshaw",
    "m14b": "walshaw",
    "vibrobox": "walshaw",
}


def graph_catalogue(spark: SparkSession, root: str = "", graphs: dict[str, str] | None = None) -> DataFrame:
    """(collection, graph, path)."""
    rows = [(c, g) for g, c in (GRAPHS if graphs is None else graphs).items()]
    return spark.createDataFrame(rows, "collection string, graph string").withColumn("path", F.concat(F.lit(root), F.col("collection"), F.lit("/"), F.col("graph"), F.lit(".graph")))
