"""Address traces and the scatter micro-operations run over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The three published dialects differ in the branch value and in some conditions.
DIALECTS = ("c", "java", "python")


def linear(spark: SparkSession, n: int) -> DataFrame:
    """(pos, addr) with addr = pos."""
    return spark.range(n).select(F.col("id").alias("pos"), F.col("id").alias("addr"))


def random(spark: SparkSession, n: int, seed: int = 12345) -> DataFrame:
    """(pos, addr) with addr spread over [0, n) by a linear congruence of the position: the same on every run and engine."""
    addr = F.pmod(F.pmod(F.col("id") * F.lit(1103515245) + F.lit(seed), F.lit(2147483648)), F.lit(max(n, 1)))
    return spark.range(n).select(F.col("id").alias("pos"), addr.alias("addr"))


def mix(trace: DataFrame, n: int) -> DataFrame:
    """The first n addresses of a merge trace in (src, dst, step) order."""
    first = trace.orderBy("src", "dst", "step").limit(n)
    return first.select((F.row_number().over(Window.orderBy("src", "dst", "step")) - 1).cast("long").alias("pos"), "addr")


def scatter(trace: DataFrame, n: int, dialect: str, branch: int) -> DataFrame:
    """(addr, op, value): final cell values of the eight micro-operations, from the number of visits of each address."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")
    c, i, b = F.col("c"), F.col("addr"), F.lit(branch)
    zero, one = F.lit(0), F.lit(1)
    var = {"c": F.lit(n), "java": one, "python": F.lit(n // 2)}[dialect]
    geq = {"c": F.when(i <= b, c).otherwise(zero), "java": c, "python": c}[dialect]
    eq = {"c": F.when(i == b, c).otherwise(zero), "java": F.when(c >= 1, one).otherwise(zero), "python": F.when(i == 0, c).otherwise(zero)}[dialect]
    three = {"c": F.when(i <= b, 2 * c).otherwise(c), "java": c + 2, "python": F.when(i == 0, 3 * c).otherwise(c)}[dialect]
    taken = i > b if dialect == "python" else i >= b
    ops = {"MEM_ONLY": zero, "INC": c, "ADD_1M": 1_000_000 * c, "ADD_VAR": var * c, "COND_GEQ": geq, "COND_EQ": eq, "COND_3": three, "BRANCH": F.when(taken, b * c).otherwise(c)}
    counts = trace.groupBy("addr").agg(F.count("*").alias("c"))
    wide = counts.select("addr", *[v.cast("long").alias(k) for k, v in ops.items()])
    return wide.unpivot("addr", list(ops), "op", "value")


def normalised(times: dict[str, float]) -> dict[str, float | None]:
    """(t - t_mem) / (t_inc - t_mem) for each operation; None where the divisor is 0."""
    base = times["INC"] - times["MEM_ONLY"]
    return {k: (v - times["MEM_ONLY"]) / base if base else None for k, v in times.items() if k != "MEM_ONLY"}
