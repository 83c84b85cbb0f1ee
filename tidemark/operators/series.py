"""Transforms of official series. Lags count rows, not months: a missing month shifts the pairs, as published tables do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio

TRANSFORMS = {"identity": 0, "diff_1": 1, "pct_change_1": 1, "pct_change_12": 12}


def transformed(series: DataFrame, keys: Sequence[str], date: str, value: str, transform: str, out: str = "value_out") -> DataFrame:
    """identity drops nulls; differences and percentages need both values, percentages a base other than 0."""
    lag = TRANSFORMS[transform]
    v = F.col(value)
    if not lag:
        return series.withColumn(out, v).where(v.isNotNull())
    base = F.lag(value, lag).over(Window.partitionBy(*keys).orderBy(date))
    rows = series.withColumn("__base", base)
    made = v - F.col("__base") if transform == "diff_1" else ratio(v - F.col("__base"), F.when(F.col("__base") != 0, F.col("__base"))) * 100
    return rows.withColumn(out, made).where(F.col(out).isNotNull()).drop("__base")
