"""Joins between forecasts, and of series with their context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keys = Sequence[str]


def paired_models(df: DataFrame, model: str, a: str, b: str, y: str, pred: str, keys: Keys, t: str) -> DataFrame:
    """The rows that two models both forecast, with the absolute errors err_a and err_b: one
    aggregate by row instead of a self join."""
    err = lambda m: F.max(F.when(F.col(model) == m, F.abs(F.col(y) - F.col(pred))))
    return df.where(F.col(model).isin(a, b)).groupBy(*keys, t).agg(err(a).alias("err_a"), err(b).alias("err_b")).dropna(subset=["err_a", "err_b"])
