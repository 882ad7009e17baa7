"""Ordinary least squares on groups, with Student's t from the regularised incomplete beta function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, by Stirling's series beyond 16."""
    far = x + 16
    series = (far - 0.5) * np.log(far) - far + 0.5 * np.log(2 * np.pi) + 1 / (12 * far) - 1 / (360 * far**3) + 1 / (1260 * far**5) - 1 / (1680 * far**7)
    return series - sum(np.log(x + k) for k in range(16))


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function of whole arrays by its continued fraction (Lentz); NaN where an argument is."""
    given, a, b = np.broadcast_arrays(*(np.asarray(v, dtype="float64") for v in (x, a, b)))
    with np.errstate(all="ignore"):
        swap = given > (a + 1) / (a + b + 2)
        x, a, b = np.where(swap, 1 - given, given), np.where(swap, b, a), np.where(swap, a, b)
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
        nonzero = lambda v: np.where(v == 0, 1e-300, v)
        c, d = np.ones_like(x), 1 / nonzero(1 - (a + b) * x / (a + 1))
        f, open_ = d.copy(), np.isfinite(front)
        for m in range(1, 500):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / nonzero(1 + k * d)
                c = nonzero(1 + k / c)
                f = np.where(open_, f * c * d, f)
            open_ = open_ & (np.abs(c * d - 1) >= 1e-14)
            if not open_.any():
                break
        out = np.where(swap, 1 - front * f, front * f)
    return np.where(given <= 0, 0.0, np.where(given >= 1, 1.0, out))


def t_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided p-values of whole arrays; 0 where t is infinite, NaN where it is NaN."""
    t, dof = np.asarray(t, dtype="float64"), np.asarray(dof, dtype="float64")
    with np.errstate(all="ignore"):
        return np.where(np.isinf(t), 0.0, incomplete_beta(dof / (dof + t * t), dof / 2, 0.5))


def t_quantile(p: float, dof: np.ndarray) -> np.ndarray:
    """The t with P(T <= t) = p for each number of degrees of freedom, by bisection of all at once."""
    if p < 0.5:
        return -t_quantile(1 - p, dof)
    dof = np.asarray(dof, dtype="float64")
    below = lambda t: 1 - t_two_sided(t, dof) / 2 < p
    low, high = np.zeros_like(dof), np.ones_like(dof)
    while below(high).any():
        high = np.where(below(high), high * 2, high)
    for _ in range(200):
        mid = (low + high) / 2
        less = below(mid)
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


def p_value(t: Column, dof: Column) -> Column:
    """Two-sided p-value; null without degrees of freedom."""

    @F.pandas_udf("double")
    def p(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series(t_two_sided(t, dof)).where((t.notna() & (dof > 0)).to_numpy())

    return p(t, dof)


def t_975(dof: Column) -> Column:
    """The 97.5 % quantile; null without degrees of freedom."""

    @F.pandas_udf("double")
    def quantile(dof: pd.Series) -> pd.Series:
        known = dof[dof > 0].drop_duplicates()
        return dof.map(dict(zip(known, t_quantile(0.975, known), strict=True))).astype("float64")

    return quantile(dof)


def linear_regression(df: DataFrame, keys: list[str], x: Column, y: Column, p: bool = True) -> DataFrame:
    """slope, intercept, rvalue, stderr, intercept_stderr, n (and pvalue) of y on x for each group.

    Rows with a null x or y don't count. Sums are of one pass; a group whose x
    is constant, or with under two rows, has null results, one of two rows no
    errors.
    """
    rows = df.select(*keys, x.cast("double").alias("_x"), y.cast("double").alias("_y")).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_x").alias("mx"), F.regr_sxx("_y", "_x").alias("sxx"), F.regr_syy("_y", "_x").alias("syy"), F.regr_sxy("_y", "_x").alias("sxy"), F.avg("_y").alias("my"))
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    r = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    dof = (F.col("n") - 2).cast("double")
    stderr = F.when(F.col("n") > 2, F.sqrt(F.try_divide(F.greatest(F.lit(0.0), 1 - F.col("rvalue") * F.col("rvalue")) * F.col("syy"), F.col("sxx") * dof)))
    out = sums.withColumn("slope", slope).withColumn("rvalue", r).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx")).withColumn("stderr", stderr)
    out = out.withColumn("intercept_stderr", F.col("stderr") * F.sqrt(F.try_divide(F.col("sxx"), F.col("n")) + F.col("mx") * F.col("mx")))
    columns = [*keys, "n", "slope", "intercept", "rvalue", "stderr", "intercept_stderr"]
    if p:
        out = out.withColumn("pvalue", p_value(F.try_divide(F.col("slope"), F.col("stderr")), dof))
        columns.append("pvalue")
    return out.select(*columns)
