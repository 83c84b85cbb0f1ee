"""Upserts: of several rows for a key the latest generation wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row for each key, the greatest in order. The order must be total for the choice to be determined."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in rows.columns])


def upsert(stored: DataFrame | None, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """stored and new as one table, new rows replacing stored ones with the same key."""
    if stored is None:
        return keep_last(new.withColumn("__gen", F.lit(1)), keys, "__gen").drop("__gen")
    both = stored.withColumn("__gen", F.lit(0)).unionByName(new.withColumn("__gen", F.lit(1)))
    return keep_last(both, keys, "__gen").drop("__gen")


def unique_and_sorted(rows: DataFrame, keys: Sequence[str]) -> bool:
    """No key twice; the guard after a merge."""
    return not rows.groupBy(*keys).count().where("count > 1").take(1)


def missing_from(new: DataFrame, old: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Rows of old, between new's first and last date for the key, that new lacks: a shorter snapshot must not replace a longer one."""
    span = new.groupBy(*keys).agg(F.min(date).alias("__lo"), F.max(date).alias("__hi"))
    inside = old.join(span, list(keys)).where(F.col(date).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
    return inside.join(new.select(*keys, date).distinct(), [*keys, date], "left_anti")


def top_k(rows: DataFrame, keys: Sequence[str], k: int, *order) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__k") <= k).drop("__k")
