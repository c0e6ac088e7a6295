"""Running out-degrees of a stream of edges: an extra, without a counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_degrees(edges: DataFrame, watermark: str | None = None, event_time: str = "ts") -> DataFrame:
    """(id, deg); write it in ``update`` or ``complete`` mode.  With a watermark, repeated edges inside it count once."""
    e = edges.where(F.col("src") != F.col("dst"))
    if watermark:
        e = e.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["src", "dst"])
    return e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
