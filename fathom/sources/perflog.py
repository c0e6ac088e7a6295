"""Measurement logs: dialect sniffing, one canonical schema, and the log writers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names of the headerless dialects, by number of fields.
HEADERLESS = {
    9: ["Algorithm", "Implementation", "Iteration", "Time", "Mispredictions", "Branches", "Instructions", "Vertices", "Edges"],
    8: ["Algorithm", "Iteration", "Time", "Mispredictions", "Branches", "Instructions", "Vertices", "Edges"],
    6: ["Algorithm", "Iteration", "Time", "Mispredictions", "Branches", "Instructions"],
}
KEYS = ["Architecture", "Algorithm", "Implementation", "Graph", "Iteration"]
TEXT = {"Architecture", "Algorithm", "Implementation", "Graph"}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_log(spark: SparkSession, path: str, architecture: str | None = None, graph: str | None = None, missing: str = "error", seconds: bool = True) -> DataFrame | None:
    """One log in canonical form: keys first, then doubles; Time in seconds.

    The first line decides the dialect: a header starts with ``Algorithm``; without one the number of fields names the columns.  Commas
    or tabs separate.  The misspelt iteration header is mended.  A log that has ``Cycles`` keeps nanoseconds, all others seconds.
    ``missing='skip'`` gives None for an absent or empty file; without ``seconds`` times stay as written.
    """
    try:
        first = spark.read.text(path).first() if exists(spark, path) else None
    except AnalysisException:
        first = None
    if first is None:
        if missing == "skip":
            return None
        raise FileNotFoundError(path)
    sep = "\t" if "\t" in first[0] else ","
    fields = [x.strip() for x in first[0].split(sep)]
    header = fields[0] == "Algorithm"
    names = ["Iteration" if x == "Itetarion" else x for x in fields] if header else HEADERLESS.get(len(fields))
    if names is None:
        raise ValueError(f"{path}: no dialect has {len(fields)} fields")
    names = [re.sub(r"[ .]+", "_", x) for x in names if x]
    schema = ", ".join(f"`{x}` {'string' if x in TEXT else 'double'}" for x in names)
    df = spark.read.csv(path, sep=sep, schema=schema, header=header, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    if "Implementation" not in names:  # algorithm and variant share one field
        parts = F.split("Algorithm", r"\s+", 2)
        df = df.withColumn("Implementation", F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).withColumn("Algorithm", F.get(parts, F.lit(0)))
    if seconds and "Cycles" in names:
        df = df.withColumn("Time", F.col("Time") * 1e-9)
    df = df.withColumns({"Graph": F.lit(graph), "Architecture": F.lit(architecture), "Iteration": F.col("Iteration").cast("long")})
    return df.select(*KEYS, *[c for c in df.columns if c not in KEYS])


def union_fill(frames: Iterable[DataFrame], fill: float | None = 0) -> DataFrame:
    """Rows of all frames by column name; a column that a frame lacks is filled (nulls that were there stay)."""
    frames = list(frames)
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    kinds = {c: f.schema[c].dataType for f in frames for c in f.columns}
    whole = lambda f: f.select([F.col(f"`{c}`") if c in f.columns else F.lit(fill).try_cast(kinds[c]).alias(c) for c in names])
    return reduce(DataFrame.unionByName, map(whole, frames))


def union_common(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all frames, on the columns that all have."""
    frames = list(frames)
    names = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return reduce(DataFrame.unionByName, [f.select(names) for f in frames])


def union_same(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all frames; raises unless their headers are the same."""
    frames = list(frames)
    if any(f.columns != frames[0].columns for f in frames):
        raise ValueError("headers differ")
    return reduce(DataFrame.unionByName, frames)


def read_logs(spark: SparkSession, root: str, architectures: Sequence[str], algorithms: Sequence[str], graphs: Sequence[str], fill: float | None = 0, common: bool = False) -> DataFrame:
    """All of ``root/<arch>-<alg>/<graph>.log`` that exist, as one frame."""
    found = [read_log(spark, f"{root}/{a}-{k}/{g}.log", a, g, "skip") for a in architectures for k in algorithms for g in graphs]
    found = [f for f in found if f is not None]
    if not found:
        raise FileNotFoundError(root)
    return union_common(found) if common else union_fill(found, fill)


# Short names of the older reports, and the columns that those of plain and of extended logs have.
SHORT = {"Algorithm": "Comp", "Implementation": "Alg", "Iteration": "Iters", "Instructions": "Insts", "Loads_Retired": "Loads", "Loads_Dispatched": "Loads", "Stores_Retired": "Stores", "Stores_Dispatched": "Stores", "Branches": "Brs", "Mispredictions": "Mispreds", "Vertices": "Vs", "Edges": "Es"}
PLAIN = ["Comp", "Alg", "Iters", "Time", "Mispreds", "Brs", "Insts", "Vs", "Es"]
EXTENDED = ["Comp", "Alg", "Iters", "Time", "Cycles", "Insts", "Loads", "Stores", "Brs", "Mispreds", "Vs", "Es"]


def read_short(spark: SparkSession, path: str, extended: bool = True) -> DataFrame:
    """A log under its short names: the extended columns if it has a header with counters and ``extended`` is set, the plain ones otherwise.

    Where a machine has counters of both kinds, retired loads and stores are meant.  Raises when an extended log lacks a column.
    """
    df = read_log(spark, path, seconds=False)
    taken: dict[str, str] = {}
    for c in sorted(df.columns, key=lambda c: c.endswith("_Dispatched")):
        if SHORT.get(c, c) not in taken.values():
            taken[c] = SHORT.get(c, c)
    named = df.select(*[F.col(c).alias(n) for c, n in taken.items()])
    wanted = EXTENDED if extended and "Cycles" in df.columns else PLAIN
    if lost := [c for c in wanted if c not in named.columns]:
        raise ValueError(f"{path}: no column {', '.join(lost)}")
    return named.select(*wanted)


def read_shorts(spark: SparkSession, root: str, architectures: Sequence[str], algorithms: Sequence[str], graphs: Sequence[str]) -> DataFrame:
    """All of ``root/<arch>-<alg>/<graph>.log`` under short names with Arch and Graph; extended columns only if every architecture has them."""
    paths = [(a, g, f"{root}/{a}-{k}/{g}.log") for a in architectures for k in algorithms for g in graphs]
    extended = all("Cycles" in (spark.read.text(p).first() or [""])[0] for _, _, p in paths)
    tagged = [read_short(spark, p, extended).withColumns({"Arch": F.lit(a), "Graph": F.lit(g)}) for a, g, p in paths]
    return union_same(tagged)


def union_tagged(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Rows of all frames with the name of theirs; headers have to be the same."""
    return union_same([f.withColumn(tag, F.lit(k)) for k, f in frames.items()])


def header_columns(counters: dict[str, bool], before: Sequence[str], after: Sequence[str]) -> list[str]:
    """Column list of a log: the supported counters between the fixed columns."""
    return [*before, *[k for k, ok in counters.items() if ok], *after]


def write_log(df: DataFrame, path: str, sep: str = "\t", order: Sequence[str] = ("Algorithm", "Implementation", "Iteration")) -> None:
    """A log with header, ordered; one small file."""
    df.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").csv(path, sep=sep, header=True)


def write_phases(df: DataFrame, path: str) -> None:
    """Betweenness statistics (phase, level, ...): traversal by ascending level, then dependency by descending level."""
    order = F.when(F.col("phase") == "traversal", F.col("level")).otherwise(-F.col("level"))
    df.coalesce(1).sortWithinPartitions(F.desc(F.col("phase") == "traversal"), order).write.mode("overwrite").csv(path, header=True)


def read_names(spark: SparkSession, path: str) -> list[str]:
    """Predictor list, one name per line."""
    return [r[0].strip() for r in spark.read.text(path, wholetext=False).collect() if r[0].strip()]


def write_names(spark: SparkSession, names: Sequence[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in names], "value string").coalesce(1).write.mode("overwrite").text(path)


RESULT_FIELDS = ["nv", "ne", "intersections", "ba_wins", "time_bb", "time_ba", "time_bac", "ratio_ba", "ratio_bac"]


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Cross-language rows: commas dropped, fields split on white space; rows of ``Python`` list both times the other way round."""
    p = F.split(F.trim(F.regexp_replace("value", ",", " ")), r"\s+")
    df = spark.read.text(path).where(F.trim("value") != "").select(F.get(p, F.lit(0)).alias("graph"), F.get(p, F.lit(1)).alias("lang"), *[F.get(p, F.lit(i + 2)).try_cast("double").alias(c) for i, c in enumerate(RESULT_FIELDS)])
    swap = F.lower("lang") == "python"
    return df.withColumns({"time_bb": F.when(swap, F.col("time_ba")).otherwise(F.col("time_bb")), "time_ba": F.when(swap, F.col("time_bb")).otherwise(F.col("time_ba"))})


def result_lines(df: DataFrame) -> DataFrame:
    """Aligned comma text of cross-language rows."""
    ints, reals = RESULT_FIELDS[:4], RESULT_FIELDS[4:]
    return df.select(F.format_string("%25s, %8s, " + ", ".join(["%8d"] * len(ints) + ["%.5f"] * len(reals)), "graph", "lang", *[F.col(c).cast("long") for c in ints], *reals).alias("value"))


SYNTHETIC_FIELDS = ["inc", "add_1m", "add_var", "cond_eq", "cond_geq", "cond_3", "branch"]


def synthetic_lines(df: DataFrame) -> DataFrame:
    """Aligned comma text of synthetic rows (trace, lang, seven normalised times, length)."""
    return df.select(F.format_string("%10s, %8s, " + ", ".join(["%.5f"] * 7) + ", %d", "trace", "lang", *SYNTHETIC_FIELDS, F.col("length").cast("long")).alias("value"))
