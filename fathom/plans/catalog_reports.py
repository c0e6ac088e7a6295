"""Queries of joins, names, units, models and report frames that the first catalogue leaves out."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import fmt, keys
from fathom.operators import betweenness as bc
from fathom.operators import models, roles
from fathom.operators import relational as rel
from fathom.plans import fixtures as fx
from fathom.plans.catalog import AI, BC_SQL, CELL, COUNTERS, CUM_SQL, LONG_SQL, SPEED_SQL, TOT_SQL, B, G, K, M, P, T, base, perf_long, perf_speedup, perf_totals, query, w
from fathom.plans.fixtures import PERF_KEYS, PERF_SQL, PERF_VALUES, r6
from fathom.sources.perflog import union_common, union_same, union_tagged

# --- joins ---------------------------------------------------------------------------------------------------------------------

MM_SQL = "mm AS (SELECT algorithm, graph, min(branches) AS branches_min, sum(branches) AS branches_sum, max(branches) AS branches_max FROM perf WHERE implementation = 'N' GROUP BY 1, 2)"


@query("perf_join_min_max", w(PERF_SQL, MM_SQL) + f"SELECT {K}, iteration, branches, CAST(branches_min AS BIGINT) AS branches_min_norm, CAST(branches_sum AS BIGINT) AS branches_sum_norm, CAST(branches_max AS BIGINT) AS branches_max_norm FROM perf JOIN mm USING (algorithm, graph)")
def _(spark, sf_dir):
    p = P(spark, sf_dir)
    norm = rel.min_sum_max(p.where(base()), ["algorithm", "graph"], ["branches"])
    return rel.join_suffixed(p.select(*PERF_KEYS, "iteration", "branches"), norm, ["algorithm", "graph"], "_norm")


LABEL_SQL = f'lab AS (SELECT {K}, max(iteration) AS label_x, max("time") AS label_y FROM perf GROUP BY {K})'


@query("perf_join_labels", w(PERF_SQL, TOT_SQL, SPEED_SQL, LABEL_SQL) + f"SELECT {K}, round(speedup, 6) AS speedup, label_x, label_y FROM sp JOIN lab USING ({K})")
def _(spark, sf_dir):
    return perf_speedup(spark, sf_dir).join(rel.label_positions(P(spark, sf_dir), PERF_KEYS, "iteration", "time"), PERF_KEYS).withColumn("speedup", r6("speedup"))


query("perf_label_start", w(PERF_SQL) + f'SELECT {K}, min(iteration) AS label_x, max("time") AS label_y FROM perf GROUP BY {K}')(lambda s, d: rel.label_positions(P(s, d), PERF_KEYS, "iteration", "time", at_end=False))
ONE_SQL = f"f AS (SELECT algorithm, implementation, sum({B} * {T}) / sum({B} * {B}) AS k FROM perf GROUP BY 1, 2)"


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.predict(perf_totals(spark, sf_dir), models.fit(P(spark, sf_dir), AI, "time", ["branches"]))


query("perf_join_predictions", w(PERF_SQL, TOT_SQL, SPEED_SQL, ONE_SQL) + f'SELECT {K}, round(k * branches, 2) AS predicted, round(speedup, 6) AS speedup FROM tot JOIN f USING (algorithm, implementation) JOIN sp USING ({K})')(
    lambda s, d: predicted(s, d).join(perf_speedup(s, d), PERF_KEYS).select(*PERF_KEYS, F.round("predicted", 2).alias("predicted"), r6("speedup").alias("speedup"))
)
query("perf_join_summary", w(PERF_SQL) + f'SELECT {K}, iteration, "time", least_time, most_time FROM perf JOIN (SELECT {K}, min("time") AS least_time, max("time") AS most_time FROM perf GROUP BY {K}) s USING ({K})')(
    lambda s, d: P(s, d).select(*PERF_KEYS, "iteration", "time").join(P(s, d).groupBy(*PERF_KEYS).agg(F.min("time").alias("least_time"), F.max("time").alias("most_time")), PERF_KEYS)
)
query("perf_join_annotations", w(PERF_SQL) + "SELECT graph, note, y_low, y_high FROM (VALUES ('BUILDING', 'a'), ('MACHINERY', 'b'), ('NOWHERE', 'c')) n(graph, note) JOIN (SELECT graph, min(\"time\") AS y_low, max(\"time\") AS y_high FROM perf GROUP BY 1) r USING (graph)")(
    lambda s, d: s.createDataFrame([("BUILDING", "a"), ("MACHINERY", "b"), ("NOWHERE", "c")], "graph string, note string").join(P(s, d).groupBy("graph").agg(F.min("time").alias("y_low"), F.max("time").alias("y_high")), "graph")
)


@query("perf_nested_languages", w(PERF_SQL) + "SELECT implementation, graph, iteration, branches FROM perf WHERE algorithm = 'F' AND implementation = 'A'")
def _(spark, sf_dir):
    """Results nested by graph and implementation, flattened and filtered by one implementation."""
    row = F.struct("iteration", "branches")
    nested = P(spark, sf_dir).where("algorithm = 'F'").groupBy("graph", "implementation").agg(F.collect_list(row).alias("rows")).groupBy("graph").agg(F.collect_list(F.struct("implementation", "rows")).alias("results"))
    flat = nested.select("graph", F.explode("results").alias("r")).select("graph", F.col("r.implementation").alias("implementation"), F.explode("r.rows").alias("x"))
    return flat.where("implementation = 'A'").select("implementation", "graph", "x.iteration", "x.branches")


# --- unions and names ----------------------------------------------------------------------------------------------------------

query("perf_union_same", w(PERF_SQL) + f"SELECT {K}, branches FROM perf WHERE iteration < 1 UNION ALL SELECT {K}, branches FROM perf WHERE iteration >= 1")(lambda s, d: union_same([P(s, d).where(c).select(*PERF_KEYS, "branches") for c in ("iteration < 1", "iteration >= 1")]))
query("perf_union_common", w(PERF_SQL) + "SELECT algorithm, branches FROM perf UNION ALL SELECT algorithm, branches FROM perf")(lambda s, d: union_common([P(s, d).select("algorithm", "time", "branches"), P(s, d).select("branches", "algorithm", "edges")]))
query("perf_union_tagged", w(PERF_SQL) + "SELECT graph, branches AS n, 'branches' AS kind FROM perf UNION ALL SELECT graph, mispredictions, 'mispredictions' FROM perf")(lambda s, d: union_tagged({c: P(s, d).select("graph", F.col(c).alias("n")) for c in ("branches", "mispredictions")}, "kind"))


def listed(spark: SparkSession, rows: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(k, i, c) for k, cs in rows.items() for i, c in enumerate(cs)], "kind string, pos int, name string")


def listed_sql(rows: dict[str, list[str]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {i}, '{c}')" for k, cs in rows.items() for i, c in enumerate(cs)) + ") x(kind, pos, name)"


NAME_SETS = {"common": ["graph", "iteration", "time", "edges"], "every": ["implementation", "graph", "iteration", "time", "edges", "algorithm", "instructions", "mispredictions", "branches", "vertices"], "rest": ["algorithm", "instructions", "mispredictions", "branches", "vertices"]}


@query("perf_name_sets", listed_sql(NAME_SETS))
def _(spark, sf_dir):
    a, b = fx.event_log(spark, sf_dir).columns, P(spark, sf_dir).columns
    both = roles.common_columns([a, b])
    order = ["graph", "iteration", "time", "edges"]
    return listed(spark, {"common": [c for c in order if c in both], "every": roles.all_columns([a, b]), "rest": [c for c in b if c not in a]})


ROLE_SETS = {"index": ["algorithm", "implementation", "graph", "iteration"], "predictors": ["mispredictions", "branches", "edges"], "response": ["time"], "first": ["graph", "time", "algorithm", "implementation", "iteration", "instructions", "mispredictions", "branches", "vertices", "edges"], "named": ["algorithm", "graph"], "unnamed": ["implementation", "iteration", "time", "instructions", "mispredictions", "branches", "vertices", "edges"]}


@query("perf_roles", listed_sql(ROLE_SETS))
def _(spark, sf_dir):
    p = P(spark, sf_dir)
    r = roles.roles(p.columns, drop_instructions=True)
    named, unnamed = rel.split_columns(p, ["graph", "algorithm"])
    return listed(spark, {"index": r.index, "predictors": r.predictors, "response": [r.response], "first": rel.first_columns(p, ["graph", "time"]).columns, "named": named, "unnamed": unnamed})


query("perf_tag_and_units", w(PERF_SQL) + 'SELECT graph, iteration, \'hsw\' AS architecture, "time" * 1e9 AS ns, "time" * 1e-9 AS s FROM perf')(lambda s, d: P(s, d).select("graph", "iteration", F.lit("hsw").alias("architecture"), (F.col("time") * 1e9).alias("ns"), (F.col("time") * 1e-9).alias("s")))
query("perf_least_of", w(PERF_SQL) + f"SELECT {K}, iteration, CASE WHEN mispredictions <= branches AND mispredictions <= vertices THEN 1 WHEN branches <= vertices THEN 2 ELSE 3 END AS least, CASE WHEN mispredictions >= branches AND mispredictions >= vertices THEN 1 WHEN branches >= vertices THEN 2 ELSE 3 END AS most FROM perf")(
    lambda s, d: P(s, d).select(*PERF_KEYS, "iteration", rel.least_of("mispredictions", "branches", "vertices").cast("int").alias("least"), rel.greatest_of("mispredictions", "branches", "vertices").cast("int").alias("most"))
)
query("perf_finite", w(PERF_SQL, "x AS (SELECT graph, CASE iteration WHEN 0 THEN -1e0 WHEN 1 THEN CAST('inf' AS DOUBLE) WHEN 2 THEN CAST('nan' AS DOUBLE) WHEN 3 THEN NULL ELSE CAST(branches AS DOUBLE) END AS v FROM perf)") + "SELECT graph, min(v) FILTER (WHERE v > 0 AND NOT isnan(v)) AS least, max(v) FILTER (WHERE isfinite(v)) AS most, count(*) FILTER (WHERE v IS NULL OR isnan(v)) AS missing FROM x GROUP BY 1")(
    lambda s, d: P(s, d)
    .select("graph", F.expr("CASE iteration WHEN 0 THEN -1.0D WHEN 1 THEN double('inf') WHEN 2 THEN double('nan') WHEN 3 THEN NULL ELSE double(branches) END").alias("v"))
    .groupBy("graph").agg(rel.min_positive("v").alias("least"), rel.max_finite("v").alias("most"), F.count(F.when(F.col("v").isNull() | F.isnan("v"), 1)).alias("missing"))
)
query("perf_not_chosen_name", w(PERF_SQL) + "SELECT DISTINCT lower(graph) AS graph FROM perf WHERE regexp_matches(graph, '^(?i:b|m)') AND lower(graph) IN ('building', 'machinery', 'household')")(lambda s, d: P(s, d).where(F.col("graph").rlike("^(?i:b|m)") & F.lower("graph").isin("building", "machinery", "household")).select(F.lower("graph").alias("graph")).distinct())
query("perf_recode", w(PERF_SQL) + "SELECT graph, CASE graph WHEN 'BUILDING' THEN 'bld' WHEN 'MACHINERY' THEN 'mch' ELSE graph END AS short, CASE graph WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 END AS place FROM perf GROUP BY 1")(
    lambda s, d: P(s, d).select("graph").distinct().select("graph", keys.recode(F.col("graph"), {"BUILDING": "bld", "MACHINERY": "mch"}).alias("short"), keys.rank_in(F.col("graph"), ["MACHINERY", "BUILDING"]).cast("int").alias("place"))
)
query("key_suffix", "SELECT * FROM (VALUES ('all_archs--F--A_N'), ('hsw--all_algs--all_codes')) x(suffix)")(lambda s, d: s.createDataFrame([(keys.suffix(a, b, c, {"archs": ["hsw", "ivb"], "algs": ["F", "O"], "codes": ["A", "N", "R"]}),) for a, b, c in ((["ivb", "hsw"], ["F"], ["N", "A"]), (["hsw"], ["O", "F"], ["R", "A", "N"]))], "suffix string"))
query("perf_descending", w(PERF_SQL, f"x AS (SELECT {K}, max(iteration) AS last FROM perf GROUP BY {K})") + f"SELECT {K}, last FROM x ORDER BY last DESC, {K} LIMIT 7")(lambda s, d: P(s, d).groupBy(*PERF_KEYS).agg(F.max("iteration").alias("last")).orderBy(F.desc("last"), *PERF_KEYS).limit(7))
query("perf_merge_order", w(PERF_SQL, TOT_SQL) + f"SELECT row_number() OVER (ORDER BY {K}) AS pos, {K} FROM tot")(lambda s, d: perf_totals(s, d).select(*PERF_KEYS).select(F.row_number().over(rel.Window.orderBy(*PERF_KEYS)).cast("long").alias("pos"), *PERF_KEYS))
query("perf_sample_rows", w(PERF_SQL) + "SELECT 20 AS n, 20 AS known, 20 AS different")(
    lambda s, d: rel.sample_rows(P(s, d), 20).join(P(s, d).select(*PERF_KEYS, "iteration", F.lit(1).alias("known")), [*PERF_KEYS, "iteration"], "left").agg(F.count("*").cast("int").alias("n"), F.sum("known").cast("int").alias("known"), F.countDistinct(*PERF_KEYS, "iteration").cast("int").alias("different"))
)

# --- units, parsing, axes ------------------------------------------------------------------------------------------------------

query("fmt_units", w(PERF_SQL, TOT_SQL) + f"SELECT {K}, kind, CAST(CAST(round_even(CASE WHEN instructions >= 1e6 THEN instructions / 1e6 WHEN instructions >= 1e3 THEN instructions / 1e3 ELSE instructions END, 0) AS BIGINT) AS VARCHAR) || ' ' || CASE WHEN instructions >= 1e6 THEN 'M' WHEN instructions >= 1e3 THEN 'K' ELSE '' END || unit AS label FROM tot, (VALUES " + ", ".join(f"('{k}', '{u}')" for k, u in fmt.UNITS.items()) + ") u(kind, unit)")(
    lambda s, d: perf_totals(s, d).select(*PERF_KEYS, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), fmt.si_unit(F.col("instructions"), k).alias("label")) for k in fmt.UNITS])).alias("u")).select(*PERF_KEYS, "u.*")
)
query("parse_numbers", w(PERF_SQL) + "SELECT graph, iteration, replace(printf('%,d', branches), ',', '') AS plain, TRY_CAST(replace(printf('%,d', branches), ',', '') AS BIGINT) AS n, TRY_CAST('x' || branches AS BIGINT) AS junk FROM perf")(
    lambda s, d: P(s, d).select("graph", "iteration", F.regexp_replace(F.format_number("branches", 0), ",", "").alias("plain")).withColumns({"n": F.col("plain").try_cast("long"), "junk": F.concat(F.lit("x"), "plain").try_cast("long")})
)
query("bit_operations", w(PERF_SQL) + "SELECT graph, iteration, branches | 8 AS set_3, (branches >> 3) & 1 = 1 AS test_3, branches & ~8 AS reset_3, CAST(bit_count(branches) AS INTEGER) AS ones, (branches < 0) <> (iteration - 2 < 0) AS signs_differ FROM perf")(
    lambda s, d: P(s, d).select("graph", "iteration", F.col("branches").bitwiseOR(F.lit(8)).alias("set_3"), (F.getbit("branches", F.lit(3)) == 1).alias("test_3"), F.col("branches").bitwiseAND(F.lit(~8)).alias("reset_3"), F.bit_count("branches").cast("int").alias("ones"), (F.col("branches").bitwiseXOR(F.col("iteration") - 2) < 0).alias("signs_differ"))
)
query("fmt_reverse_log", w(PERF_SQL) + "SELECT graph, iteration, round(-log2(branches), 6) AS y FROM perf")(lambda s, d: P(s, d).select("graph", "iteration", r6(fmt.reverse_log(F.col("branches"), 2)).alias("y")))
STEPS = "(VALUES (0e0, 10e0, 1e0), (0e0, 1e0, 0.1e0), (0e0, 3e0, 0.25e0), (0e0, 45e0, 5e0), (2e0, 2e0, 1e0)) x(low, high, step)"


@query("axis_steps", f"SELECT low, high, step FROM {STEPS}")
def _(spark, sf_dir):
    return spark.createDataFrame([(a, b, fmt.step_size(a, b)) for a, b in ((0.0, 10.0), (0.0, 1.0), (0.0, 3.0), (0.0, 45.0), (2.0, 2.0))], "low double, high double, step double")


@query("axis_ticks", "SELECT 'linear' AS kind, CAST(i AS DOUBLE) AS at FROM range(-1, 4) x(i) UNION ALL SELECT 'log2', pow(2, i) FROM range(-2, 6) x(i) UNION ALL SELECT 'log10', pow(10, i) FROM range(0, 4) x(i)")
def _(spark, sf_dir):
    rows = {"linear": fmt.ticks(-1, 3, 1.0), "log2": fmt.ticks_log(0.25, 32), "log10": fmt.ticks_log(1, 1000, 10)}
    return spark.createDataFrame([(k, float(x)) for k, xs in rows.items() for x in xs], "kind string, at double")


@query("axis_labels_log2", "SELECT pow(2, k) AS at, CASE WHEN k > 8 THEN '2^' || k WHEN k >= 0 THEN CAST(CAST(pow(2, k) AS BIGINT) AS VARCHAR) WHEN k < -8 THEN '1/2^' || -k ELSE '1/' || CAST(CAST(pow(2, -k) AS BIGINT) AS VARCHAR) END AS label FROM range(-10, 11) x(k)")
def _(spark, sf_dir):
    at = [2.0**k for k in range(-10, 11)]
    return spark.createDataFrame(list(zip(at, fmt.labels_log2(at), strict=True)), "at double, label string")


# --- models --------------------------------------------------------------------------------------------------------------------

GUARD_SQL = f"f AS (SELECT {K}, CASE WHEN count(*) >= 2 THEN sum({B} * {T}) / sum({B} * {B}) ELSE 0 END AS k FROM perf GROUP BY {K})"
query("fit_per_graph", w(PERF_SQL, GUARD_SQL) + f"SELECT {K}, round(k, 4) AS coef FROM f")(lambda s, d: models.fit(P(s, d), PERF_KEYS, "time", ["branches"], least_rows=2).coefficients(s, P(s, d).schema).select(*PERF_KEYS, F.round("coef", 4).alias("coef")))
query("fit_few_rows", w(PERF_SQL) + f"SELECT {K}, CASE WHEN count(*) >= 8 THEN round(sum({B} * {T}) / sum({B} * {B}), 4) ELSE 0 END AS coef FROM perf WHERE iteration > 0 OR graph <> 'BUILDING' GROUP BY {K}")(lambda s, d: models.fit(P(s, d).where("iteration > 0 or graph <> 'BUILDING'"), PERF_KEYS, "time", ["branches"], least_rows=8).coefficients(s, P(s, d).schema).select(*PERF_KEYS, F.round("coef", 4).alias("coef")))
L = 1e9


def lasso_sql(by: str) -> str:
    return w(PERF_SQL) + f"SELECT {by}, 'branches' AS term, round(greatest((sum({B} * {T}) - {L:.0f}) / sum({B} * {B}), 0), 4) AS coef FROM perf GROUP BY {by}"


def lasso(by: list[str]):
    return lambda s, d: models.fit(P(s, d), by, "time", ["branches"], penalty=L).coefficients(s, P(s, d).schema).withColumn("coef", F.round("coef", 4))


query("fit_l1_pooled", lasso_sql("algorithm"))(lasso(["algorithm"]))
query("fit_l1_per_code", lasso_sql("algorithm, implementation"))(lasso(AI))
query("fit_l1_per_graph", lasso_sql(K))(lasso(PERF_KEYS))
query("fit_l1_nonzero", w(PERF_SQL) + f"SELECT * FROM (SELECT {K}, 'branches' AS term, greatest((sum({B} * {T}) - 2e8) / sum({B} * {B}), 0) AS coef FROM perf GROUP BY {K}) WHERE coef > 0")(lambda s, d: models.fit(P(s, d), PERF_KEYS, "time", ["branches"], penalty=2e8).coefficients(s, P(s, d).schema, nonzero=True))
#: Two terms, of which either may have to be left out: 0 in both, one alone, or both.
TWO_SQL = f"""s AS (SELECT algorithm, implementation, sum({M}*{M}) AS mm, sum({M}*{B}) AS mb, sum({B}*{B}) AS bb, sum({M}*{T}) - {{l}} AS mt, sum({B}*{T}) - {{l}} AS bt FROM perf GROUP BY 1, 2),
o AS (SELECT *, (mt * bb - bt * mb) / (mm * bb - mb * mb) AS m2, (bt * mm - mt * mb) / (mm * bb - mb * mb) AS b2 FROM s),
c AS (SELECT algorithm, implementation, CASE WHEN m2 >= 0 AND b2 >= 0 THEN m2 WHEN greatest(mt, 0) / sqrt(mm) > greatest(bt, 0) / sqrt(bb) THEN mt / mm ELSE 0 END AS mispredictions, CASE WHEN m2 >= 0 AND b2 >= 0 THEN b2 WHEN greatest(bt, 0) / sqrt(bb) >= greatest(mt, 0) / sqrt(mm) THEN greatest(bt, 0) / bb ELSE 0 END AS branches FROM o)"""


def two(**how):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = P(spark, sf_dir)
        c = models.fit(p, AI, "time", ["mispredictions", "branches"], **how).coefficients(spark, p.schema)
        return c.groupBy(*AI).pivot("term", ["mispredictions", "branches"]).agg(F.round(F.first("coef"), 2))

    return run


query("fit_nnls2", w(PERF_SQL, TWO_SQL.format(l="0")) + "SELECT algorithm, implementation, round(mispredictions, 2) AS mispredictions, round(branches, 2) AS branches FROM c")(two(nonneg=True))
query("fit_l1_2", w(PERF_SQL, TWO_SQL.format(l="1e9")) + "SELECT algorithm, implementation, round(mispredictions, 2) AS mispredictions, round(branches, 2) AS branches FROM c")(two(penalty=1e9))
query("fit_terms_used", "SELECT * FROM (VALUES ('branches')) x(name)")(lambda s, d: s.createDataFrame([(t,) for t in models.fit(P(s, d).withColumn("nothing", F.lit(0.0)), AI, "time", ["nothing", "branches"], penalty=1.0).used_terms()], "name string"))
RES_SQL = "p AS (SELECT algorithm, implementation, k * branches AS predicted, \"time\" AS truth FROM tot JOIN f USING (algorithm, implementation))"


@query("fit_residuals", w(PERF_SQL, TOT_SQL, ONE_SQL, RES_SQL) + "SELECT algorithm, implementation, count(*) AS n, round(avg(predicted - truth), 2) AS bias, round(sqrt(avg((predicted - truth) * (predicted - truth))), 2) AS rmse, round(max(abs(predicted - truth)), 2) AS worst FROM p GROUP BY 1, 2")
def _(spark, sf_dir):
    out = models.residuals(predicted(spark, sf_dir), AI)
    return out.select(*AI, "n", *[F.round(c, 2).alias(c) for c in ("bias", "rmse", "worst")])


def stack_sql(unit: str, l: str) -> str:
    return w(PERF_SQL, TOT_SQL, TWO_SQL.format(l=l)) + f'SELECT t.algorithm, t.implementation, t.graph, round(c.mispredictions * t.mispredictions / t.{unit}, 3) AS c_mispredictions, round(c.branches * t.branches / t.{unit}, 3) AS c_branches, round((c.mispredictions * t.mispredictions + c.branches * t.branches) / t.{unit}, 3) AS predicted, round(t."time" / t.{unit}, 3) AS "true" FROM tot t JOIN c USING (algorithm, implementation)'


def stack(unit: str, **how):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = models.fit(P(spark, sf_dir), AI, "time", ["mispredictions", "branches"], **how)
        out = models.per_unit(models.predict(perf_totals(spark, sf_dir), m), unit)
        return out.select(*PERF_KEYS, *[F.round(c, 3).alias(c) for c in ("c_mispredictions", "c_branches", "predicted", "true")])

    return run


query("stack_per_instruction", stack_sql("instructions", "0"))(stack("instructions", nonneg=True))
query("stack_per_edge", stack_sql("edges", "0"))(stack("edges", nonneg=True))
query("stack_l1", stack_sql("instructions", "1e9"))(stack("instructions", penalty=1e9))

# --- report frames -------------------------------------------------------------------------------------------------------------

SIX = ["time", "mispredictions", "branches", "instructions", "vertices", "edges"]
query("perf_cumulative_all", w(PERF_SQL) + f"SELECT {K}, iteration, " + ", ".join(f'{"round(" if c == "time" else "CAST("}sum("{c}") OVER x{", 2)" if c == "time" else " AS BIGINT)"} AS "{c}"' for c in SIX) + f" FROM perf WINDOW x AS (PARTITION BY {K} ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")(
    lambda s, d: rel.cumulative(P(s, d), PERF_KEYS, "iteration", SIX).select(*PERF_KEYS, "iteration", F.round("time", 2).alias("time"), *SIX[1:])
)
MIX_SQL = "mix AS (" + " UNION ALL ".join(f"SELECT p.algorithm, p.implementation, p.graph, p.iteration, '{c}' AS key, CAST(p.{c} AS DOUBLE) / nullif(b.instructions, 0) AS value FROM perf p JOIN perf b ON b.implementation = 'N' AND b.algorithm = p.algorithm AND b.graph = p.graph AND b.iteration = p.iteration" for c in COUNTERS) + ")"


@query("report_instruction_mix", w(PERF_SQL, MIX_SQL, "med AS (SELECT implementation, key, median(m) AS median FROM (SELECT implementation, graph, key, median(value) AS m FROM mix GROUP BY 1, 2, 3) GROUP BY 1, 2)") + f"SELECT {K}, iteration, key, round(value, 6) AS value, round(median, 6) AS median FROM mix JOIN med USING (implementation, key)")
def _(spark, sf_dir):
    p = P(spark, sf_dir)
    base_instructions = p.withColumn("instr", rel.baseline(p, CELL, "instructions", base())).where("instr is not null")
    long = rel.unpivot(rel.normalise_self(base_instructions, COUNTERS, "instr"), [*PERF_KEYS, "iteration"], COUNTERS)
    median = rel.median_of_medians(long, ["implementation", "graph", "key"], ["implementation", "key"], "value")
    return long.join(median, ["implementation", "key"]).select(*PERF_KEYS, "iteration", "key", r6("value").alias("value"), r6("median").alias("median"))


query("report_mispredictions", w(PERF_SQL) + f"SELECT {K}, round(CAST(sum(mispredictions) AS DOUBLE) / nullif(sum(vertices), 0), 6) AS per_vertex, bound FROM perf, (VALUES ('F', 1), ('O', 1), ('O', 3)) r(alg, bound) WHERE alg = algorithm GROUP BY ALL")(
    lambda s, d: rel.bounds(P(s, d), PERF_KEYS, "mispredictions", "vertices", "per_vertex").join(s.createDataFrame([("F", 1), ("O", 1), ("O", 3)], "algorithm string, bound int"), "algorithm").select(*PERF_KEYS, r6("per_vertex").alias("per_vertex"), "bound")
)
WIDE_SQL = "x AS (SELECT algorithm, graph, max(CASE WHEN implementation = 'N' THEN \"time\" END) AS bb, max(CASE WHEN implementation = 'A' THEN \"time\" END) AS ba, max(CASE WHEN implementation = 'R' THEN \"time\" END) AS bac FROM tot GROUP BY 1, 2)"


def by_code(df: DataFrame, by: list[str]) -> DataFrame:
    """One column of times a code."""
    return df.groupBy(*by).agg(*[F.max(F.when(F.col("implementation") == k, F.col("time"))).alias(n) for k, n in (("N", "bb"), ("A", "ba"), ("R", "bac"))])


query("report_normalised_times", w(PERF_SQL, TOT_SQL, WIDE_SQL) + "SELECT algorithm, graph, round(ba / nullif(bb, 0), 6) AS ba, round(bac / nullif(bb, 0), 6) AS bac FROM x")(
    lambda s, d: rel.normalise_self(by_code(perf_totals(s, d), ["algorithm", "graph"]), ["ba", "bac"], "bb").select("algorithm", "graph", r6("ba").alias("ba"), r6("bac").alias("bac"))
)
query("report_win_percent", w(PERF_SQL) + "SELECT a.graph, round(100.0 * count(*) FILTER (WHERE a.\"time\" < b.\"time\") / CAST(count(*) AS DOUBLE), 4) AS percent FROM perf a JOIN perf b ON b.implementation = 'N' AND a.implementation = 'A' AND b.algorithm = a.algorithm AND b.graph = a.graph AND b.iteration = a.iteration GROUP BY 1")(
    lambda s, d: rel.wins(by_code(P(s, d), CELL).where("ba is not null and bb is not null"), ["graph"], "ba", "bb").select("graph", F.round(100 * F.col("ratio"), 4).alias("percent"))
)
@query("report_synthetic", w(PERF_SQL, "x AS (SELECT algorithm, graph, sum(CASE WHEN iteration = 0 THEN \"time\" END) AS mem, sum(CASE WHEN iteration = 1 THEN \"time\" END) AS inc, sum(CASE WHEN iteration = 2 THEN \"time\" END) AS op FROM perf GROUP BY 1, 2)") + "SELECT algorithm, graph, round((op - mem) / nullif(inc - mem, 0), 6) AS normalised FROM x")
def _(spark, sf_dir):
    """Times of a trace's operations over those of the plain increment, both without those of the bare memory walk."""
    at = lambda i: F.sum(F.when(F.col("iteration") == i, F.col("time")))
    x = P(spark, sf_dir).groupBy("algorithm", "graph").agg(at(0).alias("mem"), at(1).alias("inc"), at(2).alias("op"))
    return x.select("algorithm", "graph", r6(F.try_divide(F.col("op") - F.col("mem"), F.col("inc") - F.col("mem"))).alias("normalised"))


PLANS = [(a, c, v) for a, c, v in product(("F", "O"), ("A", "N"), ("branches", "mispredictions"))]


@query("report_batch", w(PERF_SQL) + " UNION ALL ".join(f"SELECT '{a}' AS algorithm, '{c}' AS implementation, '{v}' AS counter, CAST(sum({v}) AS BIGINT) AS total FROM perf WHERE algorithm = '{a}' AND implementation = '{c}'" for a, c, v in PLANS))
def _(spark, sf_dir):
    """Every combination of parameters as one grouped query instead of a query each."""
    wanted = spark.createDataFrame(PLANS, "algorithm string, implementation string, key string")
    sums = perf_long(spark, sf_dir).groupBy("algorithm", "implementation", "key").agg(F.sum("value").cast("long").alias("total"))
    return F.broadcast(wanted).join(sums, ["algorithm", "implementation", "key"], "left").withColumnRenamed("key", "counter")


CHOICE_SQL = """z AS (SELECT algorithm, graph, row_number() OVER (PARTITION BY algorithm, graph ORDER BY iteration) - 1 AS k, iteration, max(CASE WHEN implementation = 'N' THEN "time" END) AS bb, max(CASE WHEN implementation = 'A' THEN "time" END) AS ba FROM perf GROUP BY algorithm, graph, iteration HAVING count(*) FILTER (WHERE implementation = 'N') > 0 AND count(*) FILTER (WHERE implementation = 'A') > 0),
c AS (SELECT algorithm, graph, k, iteration, 1 AS choice, 0 AS since, CAST(0 AS DOUBLE) AS was, ba AS now FROM z WHERE k = 0
 UNION ALL SELECT z.algorithm, z.graph, z.k, z.iteration, n.choice, n.since, c.now, CASE WHEN n.choice = 1 THEN z.ba ELSE z.bb END
 FROM c JOIN z ON z.algorithm = c.algorithm AND z.graph = c.graph AND z.k = c.k + 1,
 LATERAL (SELECT CASE WHEN z.k = 1 THEN 0 WHEN c.now - c.was > 0.05 * c.now OR (abs(c.now - c.was) > 0.01 * c.now AND c.since + 1 = 1) THEN 1 WHEN c.since + 1 = 5 THEN 1 - c.choice ELSE c.choice END AS choice,
  CASE WHEN z.k = 1 OR c.now - c.was > 0.05 * c.now OR (abs(c.now - c.was) > 0.01 * c.now AND c.since + 1 = 1) OR c.since + 1 = 5 THEN 0 ELSE c.since + 1 END AS since) n)"""


@query("report_hybrid_choices", w(PERF_SQL, CHOICE_SQL) + 'SELECT algorithm, graph, iteration, choice, now AS "time" FROM c')
def _(spark, sf_dir):
    both = by_code(P(spark, sf_dir), CELL).where("ba is not null and bb is not null")
    return rel.chosen(both, ["algorithm", "graph"], "iteration", "bb", "ba")


@query("bc_equality", BC_SQL.replace("SELECT bfs.id, level, sigma, round", "SELECT bfs.id FROM bfs WHERE false --"))
def _(spark, sf_dir):
    """Rows on which dependencies by levels and those of a second run disagree: none."""
    g = G(spark, sf_dir).store()
    return bc.differences(bc.betweenness(g), bc.betweenness(g), ["level", "sigma"], ["delta"]).select("id")


FIVE = [c for c in SIX if c != "edges"]
query("perf_per_edge_all", w(PERF_SQL) + f"SELECT {K}, iteration, " + ", ".join(f'round(CAST("{c}" AS DOUBLE) / nullif(edges, 0), 6) AS "{c}"' for c in FIVE) + " FROM perf")(lambda s, d: rel.normalise_self(P(s, d), FIVE, "edges").select(*PERF_KEYS, "iteration", *[r6(c).alias(c) for c in FIVE]))
query("perf_by_speedup", w(PERF_SQL, TOT_SQL, SPEED_SQL) + f"SELECT row_number() OVER (ORDER BY speedup DESC, {K}) AS pos, {K} FROM sp WHERE implementation <> 'N'")(
    lambda s, d: perf_speedup(s, d).where(~base()).select(F.row_number().over(rel.Window.orderBy(F.desc("speedup"), *PERF_KEYS)).cast("long").alias("pos"), *PERF_KEYS)
)
query("perf_odd_even", w(PERF_SQL) + "SELECT iteration % 2 = 1 AS odd, count(*) AS n, CAST(sum(branches) AS BIGINT) AS branches FROM perf WHERE iteration >= 0 GROUP BY 1")(lambda s, d: P(s, d).where("iteration >= 0").groupBy((F.col("iteration") % 2 == 1).alias("odd")).agg(F.count("*").alias("n"), F.sum("branches").cast("long").alias("branches")))
query("perf_reciprocal", w(PERF_SQL) + 'SELECT graph, iteration, 1.0 / nullif("time", 0) AS rate FROM perf')(lambda s, d: P(s, d).select("graph", "iteration", F.try_divide(F.lit(1.0), "time").alias("rate")))
