"""Small linear models by group: one pass of Gram sums on the executors, a p x p solve on the driver.

What reaches the driver is one row of p(p+3)/2 + 3 sums per group, never data rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTERCEPT = "(Intercept)"


@dataclass
class Fit:
    """Coefficients by group key; ``r_sq`` is clamped at 0 from below."""

    keys: list[str]
    terms: list[str]
    response: str
    coefs: dict[tuple, np.ndarray] = field(default_factory=dict)
    mu: dict[tuple, float] = field(default_factory=dict)
    r_sq: dict[tuple, float] = field(default_factory=dict)

    def coefficients(self, spark, schema, nonzero: bool = False) -> DataFrame:
        """(keys, term, coef)."""
        rows = [(*k, t, float(c)) for k, cs in self.coefs.items() for t, c in zip(self.terms, cs, strict=True) if c or not nonzero]
        return spark.createDataFrame(rows, ", ".join([f"`{k}` {schema[k].dataType.simpleString()}" for k in self.keys] + ["term string", "coef double"]))

    def diagnostics(self, spark, schema) -> DataFrame:
        rows = [(*k, float(self.mu[k]), float(self.r_sq[k])) for k in self.coefs]
        return spark.createDataFrame(rows, ", ".join([f"`{k}` {schema[k].dataType.simpleString()}" for k in self.keys] + ["mu_obs double", "r_sq double"]))

    def used_terms(self) -> list[str]:
        """Union over the models of the terms with a coefficient other than 0."""
        return [t for i, t in enumerate(self.terms) if any(c[i] for c in self.coefs.values())]


def nnls(gram: np.ndarray, xy: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """Non-negative least squares on normal equations by an active set of positive terms."""
    p = len(xy)
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    g, b = gram / np.outer(scale, scale), xy / scale
    beta, free = np.zeros(p), np.zeros(p, bool)
    limit = tol * max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(10 * p + 10):
        grad = np.where(free, -np.inf, b - g @ beta)
        j = int(np.argmax(grad)) if p else 0
        if not p or grad[j] <= limit:
            break
        free[j] = True
        while free.any():
            idx = np.flatnonzero(free)
            want = np.zeros(p)
            want[idx] = np.linalg.lstsq(g[np.ix_(idx, idx)], b[idx], rcond=None)[0]
            if (want[idx] > 0).all():
                beta = want
                break
            low = idx[want[idx] <= 0]
            step = min(beta[i] / (beta[i] - want[i]) if beta[i] > want[i] else 0.0 for i in low)
            beta = beta + step * (want - beta)
            free &= beta > 1e-14
            beta[~free] = 0.0
    return beta / scale


def lasso(gram: np.ndarray, xy: np.ndarray, penalty: float, rounds: int = 10_000, tol: float = 1e-12) -> np.ndarray:
    """Non-negative minimum of 1/2 |y - Xb|^2 + penalty * sum(b), which is ``nnls`` with ``xy - penalty``.

    Coordinate descent alone creeps along terms that are nearly proportional and stops short.  It goes on only from an active set that
    does not meet the conditions of a minimum, which takes terms that depend on each other.
    """
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    want = np.where(np.diag(gram) > 0, xy - penalty, 0.0)
    beta = nnls(gram, want)
    grad = (want - gram @ beta) / scale
    limit = 1e-8 * max(1.0, float(np.abs(want / scale).max(initial=0.0)))
    if (grad <= limit).all() and (np.abs(grad[beta > 0]) <= limit).all():
        return beta
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(xy)):
            if gram[j, j] <= 0:
                continue
            new = max(0.0, (xy[j] - gram[j] @ beta + gram[j, j] * beta[j] - penalty) / gram[j, j])
            moved = max(moved, abs(new - beta[j]) * np.sqrt(gram[j, j]))
            beta[j] = new
        if moved <= tol * (1 + np.sqrt(np.abs(xy).max(initial=0.0))):
            break
    return beta


def solve(gram: np.ndarray, xy: np.ndarray, nonneg: bool, penalty: float | None = None) -> np.ndarray:
    """Least squares; non-negative when the equations are singular, or on request when a coefficient is below 0."""
    if penalty:
        return lasso(gram, xy, penalty)
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    if len(xy) and np.linalg.matrix_rank(gram / np.outer(scale, scale), tol=1e-12) == len(xy):
        beta = np.linalg.solve(gram / np.outer(scale, scale), xy / scale) / scale
        if not nonneg or (beta >= 0).all():
            return beta
    return nnls(gram, xy)


def fit(df: DataFrame, keys: Sequence[str], response: str, predictors: Sequence[str], intercept: bool = False, nonneg: bool = False, penalty: float | None = None, least_rows: int = 1) -> Fit:
    """One model per group; groups of fewer than ``least_rows`` rows get coefficients of 0.  Rows with a null in any used column are left out."""
    terms = ([INTERCEPT] if intercept else []) + list(predictors)
    col = lambda t: F.lit(1.0) if t == INTERCEPT else F.col(t).cast("double")
    y = F.col(response).cast("double")
    sums = [F.sum(col(a) * col(b)).alias(f"g{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
    sums += [F.sum(col(t) * y).alias(f"x{i}") for i, t in enumerate(terms)]
    rows = df.na.drop(subset=[response, *predictors]).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), *sums).collect()
    out, p = Fit(list(keys), terms, response), len(terms)
    for r in rows:
        key = tuple(r[k] for k in keys)
        g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
        xy = np.array([r[f"x{i}"] or 0.0 for i in range(p)])
        beta = solve(g, xy, nonneg, penalty) if r["n"] >= max(1, least_rows) else np.zeros(p)
        n = r["n"]
        mu = (r["sy"] or 0.0) / n if n else 0.0
        tot, res = (r["syy"] or 0.0) - n * mu * mu, (r["syy"] or 0.0) - 2 * beta @ xy + beta @ g @ beta
        out.coefs[key], out.mu[key], out.r_sq[key] = beta, mu, max(0.0, 1 - res / tot) if tot > 0 else 0.0
    return out


def residuals(predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, bias, rmse, worst) of predictions against the truth."""
    gap = F.col("predicted") - F.col("true")
    return predicted.groupBy(*keys).agg(F.count(gap).alias("n"), F.avg(gap).alias("bias"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.max(F.abs(gap)).alias("worst"))


def per_unit(predicted: DataFrame, unit: str) -> DataFrame:
    """Contributions, prediction and truth over a column of the same row: the stack of costs for each instruction or edge."""
    parts = [c for c in predicted.columns if c.startswith("c_")] + ["predicted", "true"]
    return predicted.withColumns({c: F.try_divide(F.col(c), F.col(unit)) for c in parts})


def predict(df: DataFrame, model: Fit, coefs: DataFrame | None = None) -> DataFrame:
    """Contribution columns ``c_<term>``, their sum ``predicted``, and the response as ``true``.

    The coefficients are one row per model, so the broadcast side is as small as the number of models.
    """
    schema = df.schema
    coefs = model.coefficients(df.sparkSession, schema) if coefs is None else coefs
    wide = coefs.groupBy(*model.keys).pivot("term", model.terms).agg(F.first("coef"))
    wide = wide.select(*model.keys, *[F.coalesce(F.col(f"`{t}`"), F.lit(0.0)).alias(f"_w{i}") for i, t in enumerate(model.terms)])
    joined = df.join(wide, list(model.keys)) if model.keys else df.crossJoin(wide)  # without keys the right side is one row
    name = lambda t: "c_intercept" if t == INTERCEPT else f"c_{t}"
    parts = {name(t): F.col(f"_w{i}") * (F.lit(1.0) if t == INTERCEPT else F.col(t).cast("double")) for i, t in enumerate(model.terms)}
    out = joined.withColumns(parts)
    total = sum((F.col(f"`{n}`") for n in parts), F.lit(0.0))
    return out.withColumns({"predicted": total, "true": F.col(model.response).cast("double")}).drop(*[f"_w{i}" for i in range(len(model.terms))])
