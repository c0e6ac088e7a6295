"""Operations on measurement frames: totals, baselines, speedups, running sums, reshaping, statistics.

Baselines are conditional windows rather than self-joins: one shuffle on the keys instead of two and a join.  Division is
``try_divide``: a zero divisor gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Cols = Sequence[str]


def aggregate(df: DataFrame, keys: Cols, values: Cols, reduce: Callable[[str], Column] = F.sum, suffix: str = "") -> DataFrame:
    """One reduction of every value column by group."""
    return df.groupBy(*keys).agg(*[reduce(c).alias(c + suffix) for c in values])


def totals(df: DataFrame, keys: Cols, values: Cols, iteration: str = "iteration") -> DataFrame:
    """Sums by group; the iteration column becomes the number of iterations (largest + 1)."""
    return df.groupBy(*keys).agg((F.max(iteration) + 1).alias(iteration), *[F.sum(c).alias(c) for c in values])


def min_sum_max(df: DataFrame, keys: Cols, values: Cols) -> DataFrame:
    return df.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in values for n, f in (("min", F.min), ("sum", F.sum), ("max", F.max))])


def baseline(df: DataFrame, keys: Cols, value: str, base: Column, reduce: Callable[[Column], Column] = F.max) -> Column:
    """The baseline's value seen from every row of the same keys."""
    return reduce(F.when(base, F.col(value))).over(Window.partitionBy(*keys))


def normalise(df: DataFrame, keys: Cols, values: Cols, base: Column, reduce: Callable[[Column], Column] = F.max) -> DataFrame:
    """Each value over the baseline's; rows without a baseline are dropped, as an inner join would."""
    marked = df.withColumn("_has", F.max(F.when(base, 1)).over(Window.partitionBy(*keys)))
    marked = marked.withColumns({f"_b_{c}": baseline(df, keys, c, base, reduce) for c in values})
    return marked.where("_has = 1").withColumns({c: F.try_divide(F.col(c), F.col(f"_b_{c}")) for c in values}).drop("_has", *[f"_b_{c}" for c in values])


def normalise_self(df: DataFrame, values: Cols, by: str) -> DataFrame:
    """Each value over another column of the same row."""
    return df.withColumns({c: F.try_divide(F.col(c), F.col(by)) for c in values})


def normalise_join(df: DataFrame, norm: DataFrame, keys: Cols, values: Cols) -> DataFrame:
    """Division by a normaliser frame that holds the keys and the values, joined on all keys."""
    n = norm.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in values])
    return df.join(n, list(keys)).withColumns({c: F.try_divide(F.col(c), F.col(f"_n_{c}")) for c in values}).drop(*[f"_n_{c}" for c in values])


def join_suffixed(df: DataFrame, other: DataFrame, keys: Cols, suffix: str) -> DataFrame:
    """Inner join on the keys; the other frame's values get the suffix."""
    return df.join(other.select(*keys, *[F.col(c).alias(c + suffix) for c in other.columns if c not in keys]), list(keys))


def speedup(df: DataFrame, keys: Cols, value: str, base: Column, name: str = "speedup") -> DataFrame:
    """Baseline over own; iteration totals are no key, so implementations with other round counts stay."""
    return df.withColumn("_b", baseline(df, keys, value, base)).where("_b is not null").withColumn(name, F.try_divide(F.col("_b"), F.col(value))).drop("_b")


def cumulative(df: DataFrame, keys: Cols, order: str, values: Cols) -> DataFrame:
    """Running sums within a group, by one shared window."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.sum(c).over(w) for c in values})


def unpivot(df: DataFrame, fixed: Cols, values: Cols, key: str = "key", value: str = "value") -> DataFrame:
    return df.select(*fixed, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(list(fixed), list(values), key, value)


def median_of_medians(df: DataFrame, inner: Cols, outer: Cols, value: str) -> DataFrame:
    """Exact interpolated medians by ``inner``, then the median of those by ``outer``."""
    return df.groupBy(*inner).agg(F.median(value).alias("m")).groupBy(*outer).agg(F.median("m").alias("median"))


def box_stats(df: DataFrame, keys: Cols, value: str) -> DataFrame:
    """Quartiles and whiskers: the furthest values within 1.5 times the quartile distance."""
    q = df.groupBy(*keys).agg(*[F.percentile(value, p).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.when(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach), F.col(value))
    return df.join(q, list(keys)).groupBy(*keys, "q1", "median", "q3").agg(F.min(inside).alias("low"), F.max(inside).alias("high"))


def correlation(x: str, y: str) -> Column:
    """Pearson's r from centred moments; null where a side has no spread (the built-in raises there)."""
    return F.try_divide(F.covar_pop(x, y), F.when(F.least(F.stddev_pop(x), F.stddev_pop(y)) > 0, F.stddev_pop(x) * F.stddev_pop(y)))


def correlation_matrix(df: DataFrame, values: Cols, keys: Cols = ()) -> DataFrame:
    """(keys, var_x, var_y, rho) over all pairs, in one pass."""
    pairs = [(x, y) for x in values for y in values]
    wide = df.groupBy(*keys).agg(*[correlation(x, y).alias(f"{x}|{y}") for x, y in pairs])
    long = wide.unpivot(list(keys), [f"{x}|{y}" for x, y in pairs], "pair", "rho") if keys else wide.withColumn("_k", F.lit(0)).unpivot("_k", [f"{x}|{y}" for x, y in pairs], "pair", "rho").drop("_k")
    parts = F.split("pair", r"\|")
    return long.select(*keys, parts[0].alias("var_x"), parts[1].alias("var_y"), "rho")


def correlations_with(df: DataFrame, keys: Cols, target: str, others: Cols) -> DataFrame:
    return df.groupBy(*keys).agg(*[correlation(target, c).alias(f"r_{c}") for c in others])


def mean_relative_error(df: DataFrame, keys: Cols, predicted: str, true: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.try_divide(F.abs(F.col(predicted) - F.col(true)), F.col(true))).alias("mean_rel_err"))


def having_min(df: DataFrame, keys: Cols, value: str, least: float) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias(f"min_{value}")).where(F.col(f"min_{value}") >= least)


def zero_columns(df: DataFrame, values: Cols) -> DataFrame:
    """(column, all_zero) in one pass; nulls do not count against a column."""
    wide = df.agg(*[F.coalesce(F.bool_and(F.col(c) == 0), F.lit(True)).alias(c) for c in values]).withColumn("_k", F.lit(0))
    return wide.unpivot("_k", list(values), "column", "all_zero").drop("_k")


def drop_zero_columns(df: DataFrame, values: Cols) -> DataFrame:
    return df.drop(*[r[0] for r in zero_columns(df, values).where("all_zero").collect()])


def label_positions(df: DataFrame, keys: Cols, x: str, y: str, at_end: bool = True) -> DataFrame:
    """Where a label goes: the last (or first) x and the largest y of the group."""
    return df.groupBy(*keys).agg((F.max if at_end else F.min)(x).alias("label_x"), F.max(y).alias("label_y"))


def wins(df: DataFrame, keys: Cols, a: str, b: str) -> DataFrame:
    """How often a < b, and the share."""
    w = F.count_if(F.col(a) < F.col(b))
    return df.groupBy(*keys).agg(w.alias("wins"), F.count("*").alias("n"), F.try_divide(w, F.count("*")).alias("ratio"))


def bounds(df: DataFrame, keys: Cols, top: str, bottom: str, name: str) -> DataFrame:
    """Ratio of two group sums."""
    return df.groupBy(*keys).agg(F.try_divide(F.sum(top), F.sum(bottom)).alias(name))


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n random rows (a sampling operator: top n of a random key, kept per task before the merge)."""
    return df.orderBy(F.rand(seed)).limit(n)


def head(df: DataFrame, n: int, order: Cols) -> DataFrame:
    return df.orderBy(*order).limit(n)


def split_columns(df: DataFrame, names: Cols) -> tuple[list[str], list[str]]:
    """(named columns that exist, the rest), both in the frame's order."""
    return [c for c in df.columns if c in names], [c for c in df.columns if c not in names]


def first_columns(df: DataFrame, names: Cols) -> DataFrame:
    a, b = split_columns(df, names)
    return df.select(*[n for n in names if n in a], *b)


def level_changes(df: DataFrame, order: str, value: str, keys: Cols = ()) -> DataFrame:
    """``changed`` marks the rows at which the value differs from the row before, when rows stand by value and then by ``order``: the
    first of each value of a group.  So it is a minimum by value, which no single task has to sort."""
    first = df.groupBy(*keys, value).agg(F.min(order).alias("_f"))
    return df.join(first, [*keys, value]).withColumn("changed", F.col(order) == F.col("_f")).select(*df.columns, "changed")


def least_of(*cols: str) -> Column:
    """1-based position of the smallest of several columns, the first on ties."""
    a = F.array(*cols)
    return F.array_position(a, F.array_min(a))


def greatest_of(*cols: str) -> Column:
    a = F.array(*cols)
    return F.array_position(a, F.array_max(a))


def min_positive(c: str) -> Column:
    return F.min(F.when(F.col(c) > 0, F.col(c)))


def max_finite(c: str) -> Column:
    return F.max(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)))


def chosen(df: DataFrame, keys: Cols, order: str, based: str, avoiding: str, gradient: float = 0.05, steady: float = 0.01, stuck: int = 5) -> DataFrame:
    """(keys, order, choice, time): ``choose_by_time`` for every group, as one fold over its rounds (a search has few of them)."""
    kind = "array<struct<at:bigint,choice:int,time:double>>"
    rounds = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("at"), F.array(F.col(based).cast("double"), F.col(avoiding).cast("double")).alias("t"))))
    start = F.struct(F.lit(0).alias("k"), F.lit(0.0).cast("double").alias("before"), F.lit(0.0).cast("double").alias("now"), F.lit(0).alias("since"), F.array().cast(kind).alias("out"))

    def step(s: Column, r: Column) -> Column:
        last = F.when(s["k"] == 0, F.lit(0)).otherwise(F.element_at(s["out"], -1)["choice"])
        since = s["since"] + 1
        swap = (s["now"] - s["before"] > gradient * s["now"]) | ((F.abs(s["now"] - s["before"]) > steady * s["now"]) & (since == 1))
        later = F.when(swap, F.struct(F.lit(1).alias("choice"), F.lit(0).alias("since"))).otherwise(F.struct(F.when(since == stuck, 1 - last).otherwise(last).alias("choice"), F.when(since == stuck, F.lit(0)).otherwise(since).alias("since")))
        pick = F.when(s["k"] == 0, F.struct(F.lit(1).alias("choice"), F.lit(0).alias("since"))).when(s["k"] == 1, F.struct(F.lit(0).alias("choice"), F.lit(0).alias("since"))).otherwise(later)
        time = F.get(r["t"], pick["choice"])
        row = F.struct(r["at"].alias("at"), pick["choice"].alias("choice"), time.alias("time"))
        return F.struct((s["k"] + 1).alias("k"), s["now"].alias("before"), time.alias("now"), pick["since"].alias("since"), F.concat(s["out"], F.array(row)).alias("out"))

    out = df.groupBy(*keys).agg(F.aggregate(rounds, start, step, lambda s: s["out"]).alias("r"))
    return out.select(*keys, F.explode("r").alias("r")).select(*keys, F.col("r.at").alias(order), F.col("r.choice").alias("choice"), F.col("r.time").alias("time"))


def choose_by_time(times: Sequence[tuple[float, float]], gradient: float = 0.05, steady: float = 0.01, stuck: int = 5) -> list[int]:
    """Which of two variants each iteration takes, 0 with branches or 1 without, given what either would take in it.

    The first iteration is 1, the second 0.  From then on 1 is taken when the last iteration took over ``gradient`` of its own time more
    than the one before, or moved by over ``steady`` right after a swap; ``stuck`` iterations without either swap variants.  Has no
    influence on any answer.
    """
    out = [1, 0][: len(times)]
    if len(times) < 3:
        return out
    before, now, since = times[0][1], times[1][0], 0
    for both in times[2:]:
        since += 1
        choice = out[-1]
        if now - before > gradient * now or (abs(now - before) > steady * now and since == 1):
            choice, since = 1, 0
        if since == stuck:
            choice, since = 1 - choice, 0
        out.append(choice)
        before, now = now, both[choice]
    return out
