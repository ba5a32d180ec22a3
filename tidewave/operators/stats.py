"""Functionals of series: mean, population deviation, extremes, and moment ratios with a small term in the denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ("mean", "std", "min", "max", "skewness", "kurtosis")


def moments(value: Column) -> dict[str, Column]:
    """Aggregates of one column. Third and fourth moments come from Spark's one-pass central moments."""
    sd = F.stddev_pop(value)
    third = F.coalesce(F.when(sd > 0, F.skewness(value)), F.lit(0.0)) * sd * sd * sd
    fourth = F.coalesce(F.when(sd > 0, F.kurtosis(value) + 3), F.lit(0.0)) * sd * sd * sd * sd
    return {"mean": F.avg(value), "std": sd, "min": F.min(value), "max": F.max(value), "skewness": third / (sd * sd * sd + 1e-8), "kurtosis": fourth / (sd * sd * sd * sd + 1e-8) - 3}


def functionals(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """{value}_{stat} for every value column and statistic, one row per key: one aggregation, whatever the number of columns."""
    return rows.groupBy(*keys).agg(*[col.alias(f"{v}_{s}") for v in values for s, col in moments(F.col(v)).items()])


def summarize_matrix(rows: DataFrame, keys: list[str], index: str, value: str, prefix: str, size: int) -> DataFrame:
    """{prefix}_mean_i and {prefix}_std_i of long rows (keys, index, value), one row per key."""
    picked = lambda i: F.when(F.col(index) == i, F.col(value))
    return rows.groupBy(*keys).agg(*[F.avg(picked(i)).alias(f"{prefix}_mean_{i}") for i in range(size)], *[F.stddev_pop(picked(i)).alias(f"{prefix}_std_{i}") for i in range(size)])
