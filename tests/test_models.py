import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import fmt, keys
from fathom.operators import models, roles
from fathom.operators import relational as rel


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    rows = []
    for k in ("a", "b"):
        for i in range(40):
            x, z = rng.random(), rng.random()
            rows.append((k, i, x, z, 3 * x + (2 * z if k == "a" else -1 * z) + 0.01 * rng.random()))
    return spark.createDataFrame([*rows, ("c", 0, 1.0, 1.0, 1.0), ("a", 99, None, 1.0, 2.0)], "k string, i long, x double, z double, y double")


def arrays(data, k):
    r = [x for x in data.where((F.col("k") == k) & F.col("x").isNotNull()).collect()]
    return np.array([[x.x, x.z] for x in r]), np.array([x.y for x in r])


def test_least_squares_and_fallback(spark, data):
    m = models.fit(data, ["k"], "y", ["x", "z"], least_rows=2)
    x, y = arrays(data, "a")
    assert np.allclose(m.coefs["a",], np.linalg.lstsq(x, y, rcond=None)[0])
    assert (m.coefs["c",] == 0).all()
    n = models.fit(data, ["k"], "y", ["x", "z"], nonneg=True)
    for k in ("a", "b"):
        x, y = arrays(data, k)
        b = n.coefs[k,]
        slope = x.T @ (y - x @ b)
        assert (b >= 0).all() and (slope[b == 0] <= 1e-6).all() and np.abs(slope[b > 0]).max(initial=0) < 1e-6
    assert n.coefs["b",][1] == 0 and 0 <= n.r_sq["b",] <= 1
    twice = models.fit(data.withColumn("w", F.col("x")), ["k"], "y", ["x", "w"])  # singular: falls back
    assert (twice.coefs["a",] >= 0).all() and np.isfinite(twice.coefs["a",]).all()


def test_lasso_shrinks(data):
    free, tight = (models.fit(data, ["k"], "y", ["x", "z"], penalty=p).coefs["a",] for p in (1e-9, 5.0))
    x, y = arrays(data, "a")
    assert np.allclose(free, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-5) and tight.sum() < free.sum()
    assert (models.fit(data, [], "y", ["x"], penalty=1e9).coefs[()] == 0).all()


def test_predict(spark, data):
    m = models.fit(data, ["k"], "y", ["x", "z"], intercept=True)
    for r in models.predict(data.na.drop(), m).collect():
        assert abs(r.predicted - (r.c_intercept + r.c_x + r.c_z)) < 1e-9 and r.true == r.y
    assert set(m.used_terms()) <= {models.INTERCEPT, "x", "z"}
    assert m.diagnostics(spark, data.schema).count() == 3


def test_correlation_without_spread(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "x double, y double")
    rho = {(r.var_x, r.var_y): r.rho for r in rel.correlation_matrix(df, ["x", "y"]).collect()}
    assert rho["x", "y"] is None and abs(rho["x", "x"] - 1) < 1e-9


def test_small_columns(spark):
    df = spark.createDataFrame([(3.0, 1.0, 2.0)], "a double, b double, c double")
    assert df.select(rel.least_of("a", "b", "c"), rel.greatest_of("a", "b", "c")).first() == (2, 1)
    vals = spark.createDataFrame([(-1.0,), (0.5,), (float("inf"),)], "v double")
    assert vals.agg(rel.min_positive("v"), rel.max_finite("v")).first() == (0.5, 0.5)
    assert rel.drop_zero_columns(spark.createDataFrame([(0, 1)], "z int, o int"), ["z", "o"]).columns == ["o"]
    assert rel.first_columns(df, ["c", "zz"]).columns == ["c", "a", "b"]
    assert rel.choose_by_time([]) == [] and rel.choose_by_time([(1.0, 1.0)]) == [1]
    # steady from the start: the second stays for five rounds, then both take turns
    assert rel.choose_by_time([(1.0, 1.0)] * 13) == [1, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 0, 0]
    # the branchy one is slower: back at once, and once more right after the swap
    assert rel.choose_by_time([(2.0, 1.0)] * 6) == [1, 0, 1, 1, 1, 1]
    # it moves a little right after a swap
    assert rel.choose_by_time([(1.0, 1.02)] * 3) == [1, 0, 1]
    assert rel.choose_by_time([(1.0, 1.005)] * 3) == [1, 0, 0]


def test_format(spark):
    df = spark.createDataFrame([(0.0,), (1234.5,), (0.00123,), (None,), (-2.5e6,)], "x double")
    assert [r[0] for r in df.select(fmt.sigfig_label(F.col("x"), 3)).collect()] == ["0.00", "1230", "0.00123", "NA", "-2500000"]
    assert [r[0] for r in df.select(fmt.si(F.col("x"), "B")).collect()] == ["0 B", "1 KB", "1 mB", None, "-2500000 B"]
    assert spark.range(1).select(fmt.iec(F.lit(1536)), fmt.iec(F.lit(1536), places=1), fmt.times_label(F.lit(1.256)), fmt.si_unit(F.lit(2e9), "flops")).first() == ("2 Ki", "1.5 Ki", "1.26x", "2 Gflop/s")
    assert fmt.step_size(0, 10) == 1.0 and fmt.ticks(0, 1)[-1] == 1.0 and fmt.ticks_log(1, 8) == [1.0, 2.0, 4.0, 8.0] and fmt.labels_log2([0.5, 1024.0]) == ["1/2", "2^10"]


def test_keys(spark):
    r = spark.range(1).select(keys.encode(F.lit("a"), F.lit("b"), F.lit("c")).alias("k")).select(*keys.decode(F.col("k"))).first()
    assert tuple(r) == ("a", "b", "c", None)
    known = {"archs": ["x", "y"], "algs": ["sv"], "codes": ["bb", "bl"]}
    assert keys.suffix(["y", "x"], ["sv"], ["bb"], known) == "all_archs--all_algs--bb"
    assert spark.range(1).select(keys.recode(F.lit("q"), {"q": "long"}), keys.rank_in(F.lit("b"), ["a", "b"])).first() == ("long", 2)


def test_roles():
    r = roles.roles(["architecture", "iteration", "Time", "Cycles", "Loads.Retired", "Stall.RS", "Instructions", "Edges", "Vertices"], drop_instructions=True)
    assert r.response == "Cycles" and r.stalls == ["Stall.RS"] and r.predictors == ["Loads.Retired", "Stall.RS", "Edges"]
    assert roles.common_columns([["a", "b"], ["b"]]) == ["b"] and roles.all_columns([["a"], ["b", "a"]]) == ["a", "b"]


def test_lasso_of_nearly_proportional_terms():
    """Coordinate descent stopped at (6.0, 0.0) here, before the second term had taken the place of the first."""
    x = np.array([[1000.0, 2000.0], [2000.0, 4000.1], [3000.0, 5999.9], [4000.0, 8000.1]]) * 1000
    y = x @ np.array([0.0, 3.0])
    beta = models.lasso(x.T @ x, x.T @ y, 1e6)
    grad = x.T @ (y - x @ beta) - 1e6
    assert beta[0] == 0 and abs(beta[1] - 3) < 1e-6 and grad[0] <= 0 and abs(grad[1]) < 1
    same = np.array([[1.0, 2.0, 1.0], [2.0, 4.0, 2.0]])
    assert np.allclose(models.lasso(same.T @ same, same.T @ np.array([2.0, 4.0]), 0.5), [0, 0.975, 0])
