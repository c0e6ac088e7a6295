"""Graph model: ``edges(src, dst)`` with both directions stored, optional ``vertices(id)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.plans.staging import checkpoint

#: Frames of at most this many two-column rows (some 16 MB) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Graph:
    """Canonical undirected graph: distinct edges without loops, each stored in both directions.

    Null endpoints are dropped on construction: an edge without an end is none.
    """

    edges: DataFrame
    isolated: DataFrame | None = None
    stored: bool = False

    @staticmethod
    def from_pairs(pairs: DataFrame, src: str = "src", dst: str = "dst", vertices: DataFrame | None = None) -> Graph:
        p = pairs.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a <> b")
        once = p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        ends = F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in ("ab", "ba")])
        return Graph(once.select(F.explode(ends).alias("e")).select("e.*"), vertices)

    def store(self) -> Graph:
        """The same graph with its edges written once to the shared folder: for searches, which read them every round."""
        return self if self.stored else Graph(checkpoint(self.edges), self.isolated, True)

    @property
    def vertices(self) -> DataFrame:
        ids = self.edges.select(F.col("src").alias("id"))
        return (ids if self.isolated is None else ids.unionByName(self.isolated.select(F.col("id").cast("long")))).distinct()

    def degrees(self) -> DataFrame:
        """(id, deg); isolated vertices have degree 0."""
        deg = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
        if self.isolated is None:
            return deg
        zero = self.isolated.select(F.col("id").cast("long"), F.lit(0).cast("long").alias("deg"))
        return deg.unionByName(zero).groupBy("id").agg(F.max("deg").alias("deg"))

    def degree_histogram(self) -> DataFrame:
        return self.degrees().groupBy("deg").agg(F.count("*").alias("vertices"))

    def adjacency(self) -> DataFrame:
        """(id, nbrs ascending, deg): the columnar form of compressed rows."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("nbrs")).withColumn("deg", F.size("nbrs").cast("long"))

    def unsorted(self, seed: int = 0) -> DataFrame:
        """(id, nbrs) with neighbours in a repeatable pseudo-random order, the same on any partitioning."""
        key = F.struct(F.pmod(F.col("dst") * F.lit(1103515245) + F.col("src") * F.lit(12345) + F.lit(seed), F.lit(2147483647)).alias("k"), F.col("dst"))
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["dst"]).alias("nbrs"))

    def root(self) -> int | None:
        """Smallest vertex id."""
        return self.edges.agg(F.min("src")).first()[0]


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint behind a size check on a row count that the caller has measured."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
