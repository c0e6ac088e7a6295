"""Session defaults shared by tests, bench and ad-hoc use."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", **conf) -> SparkSession:
    """A local session; on a cluster callers bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("fathom").config("spark.driver.memory", memory)
    for key, value in (DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
