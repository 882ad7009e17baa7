"""Trends and anomalies of series and of each cell of a field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarmesh.functions.stats import linear_regression, t_975
from polarmesh.operators.reductions import GROUPINGS, anomalies


def trend_with_interval(series: DataFrame, x: str, y: str) -> DataFrame:
    """Each row of a series with the fitted line and its 95 % band: x, y, fit, low, high."""
    row = linear_regression(series, [], F.col(x), F.col(y), p=False).first()
    clean = series.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    mean, sxx = clean.agg(F.avg(x), F.regr_sxx(F.col(y), F.col(x))).first()
    slope, intercept, n = row["slope"] or 0.0, row["intercept"] or 0.0, row["n"]
    fit = F.col(x) * slope + intercept
    sq = clean.agg(F.sum((F.col(y) - fit) * (F.col(y) - fit))).first()[0] or 0.0
    error = (sq / (n - 2)) ** 0.5 if n > 2 else 0.0
    half = t_975(F.lit(float(n - 2))) * error * F.sqrt(F.lit(1.0 / max(n, 1)) + F.try_divide((F.col(x) - mean) * (F.col(x) - mean), F.lit(sxx)))
    return series.select(x, y, fit.alias("fit"), (fit - half).alias("low"), (fit + half).alias("high"))


def cell_regression(field: DataFrame, value: str, keys: tuple[str, ...] = ("node_id",), deseason: bool = False, p: bool = True) -> DataFrame:
    """OLS of each cell's values on time in years, after removing each cell's monthly climatology if `deseason`."""
    rows = anomalies(field, value, keys) if deseason else field
    years = F.year("time") + (F.dayofyear("time") - 1) / 365.25
    return linear_regression(rows, list(keys), years, F.col(value), p=p)


def anomaly(field: DataFrame, value: str, first_year: int, last_year: int, how: str = "annual_mean", keys: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """Annual aggregates less their mean over the reference years (both included): keys, year, value."""
    if how not in GROUPINGS:
        raise ValueError(f"how is one of {sorted(GROUPINGS)}, not {how!r}")
    by_year = field.groupBy(*keys, F.year("time").alias("year")).agg(GROUPINGS[how](value).alias(value))
    mean = by_year.where(F.col("year").between(first_year, last_year)).groupBy(*keys).agg(F.avg(value).alias("_m"))
    return by_year.join(mean, list(keys)).select(*keys, "year", (F.col(value) - F.col("_m")).alias(value))


def split_regression(series: DataFrame, x: str, y: str, split: float | None = None, p: bool = True) -> DataFrame:
    """One regression, or, with `split`, two: of x up to it and beyond (segment 0 and 1)."""
    segment = F.lit(0) if split is None else F.when(F.col(x) > split, 1).otherwise(0)
    return linear_regression(series.withColumn("segment", segment), ["segment"], F.col(x), F.col(y), p=p)
