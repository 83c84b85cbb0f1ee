"""Prefix scans and order statistics over groups of any size, none of which is ever one task's.

`earlier` gives each row the statistics of strictly earlier rows of its group: states of blocks of time (number, mean, sum of squared deviations, largest size, last instant) are merged along the blocks of a
group, a row each, and windows run within blocks only. `running_total` does the same for sums along any order, with blocks cut by range partitioning; ranks and exact
quantiles follow from counts of distinct values and their running totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import DAY_US, long
from ..store import written

#: Of a measure: number, mean, sum of squared deviations, largest absolute value, last instant.
_STATE = ("n", "m", "q", "x", "t")


def _same(left: DataFrame, right: DataFrame, on: Mapping[str, str], how: str) -> DataFrame:
    """left joined with right where left's columns equal right's of other names, nulls too; right's key columns are dropped."""
    met = F.lit(True)
    for a, b in on.items():
        met = met & F.col(a).eqNullSafe(F.col(b))
    return left.join(right, met, how).drop(*on.values())


def _before(groups: Sequence[str], measures: Sequence[str]):  # noqa: ANN202
    """For the blocks of one group, in order, what all earlier ones amount to (Chan, Golub and LeVeque's merging)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__b").reset_index(drop=True)
        out = {g: frame[g] for g in (*groups, "__b")}
        for k in measures:
            n, m, q, x, t = (frame[f"{k}_{s}"].to_numpy() for s in _STATE)
            made = np.zeros((len(frame), 5))
            have = [0.0, 0.0, 0.0, np.nan, np.nan]
            for i in range(len(frame)):
                made[i] = have
                if n[i]:
                    total = have[0] + n[i]
                    d = m[i] - have[1]
                    have = [total, have[1] + d * n[i] / total, have[2] + q[i] + d * d * have[0] * n[i] / total, np.nanmax([have[3], x[i]]), np.nanmax([have[4], t[i]])]
            out |= {f"{k}_{s}0": made[:, j] for j, s in enumerate(_STATE)}
        return pd.DataFrame(out)

    return run


def earlier(rows: DataFrame, group: Sequence[str], t_us: str, measures: Mapping[str, Column], block_us: int = DAY_US) -> DataFrame:
    """rows with, for each measure k, k_n, k_m (mean), k_s (standard deviation, n - 1), k_x (largest absolute value) and k_t (last instant) of its non-null values at strictly earlier instants of the group.

    Rows of equal instants never see each other. Rows without an instant see nothing. A block is a stretch of block_us; its rows are one window's.
    """
    g, names = list(group), list(measures)
    block = F.coalesce(F.floor(F.col(t_us) / long(block_us)), F.lit(-(1 << 62)))
    cut = rows.withColumns({**{f"__v_{k}": F.when(F.col(t_us).isNotNull(), c) for k, c in measures.items()}, "__b": block})
    v = {k: F.col(f"__v_{k}") for k in names}
    at = {k: F.when(v[k].isNotNull(), F.col(t_us)) for k in names}
    parts = {k: (F.count(v[k]), F.avg(v[k]), F.var_pop(v[k]) * F.count(v[k]), F.max(F.abs(v[k])), F.max(at[k])) for k in names}
    kinds = dict(rows.dtypes)
    states = cut.groupBy(*g, "__b").agg(*[c.cast("double").alias(f"{k}_{s}") for k in names for s, c in zip(_STATE, parts[k], strict=True)])
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in g), "__b long", *(f"{k}_{s}0 double" for k in names for s in _STATE)])
    offsets = states.groupBy(*g).applyInPandas(_before(g, names), schema)
    offsets = offsets.toDF(*[f"__g{i}" for i in range(len(g))], "__gb", *[c for c in offsets.columns if c not in (*g, "__b")])
    w = Window.partitionBy(*g, "__b").orderBy(t_us).rangeBetween(Window.unboundedPreceding, -1)
    own = {f"__{k}_{s}": c.over(w) for k in names for s, c in zip(_STATE, (F.count(v[k]), F.avg(v[k]), F.var_pop(v[k]), F.max(F.abs(v[k])), F.max(at[k])), strict=True)}
    both = _same(cut.withColumns(own), offsets, {**{c: f"__g{i}" for i, c in enumerate(g)}, "__b": "__gb"}, "left")
    out = {}
    for k in names:
        n1, n0 = F.col(f"__{k}_n").cast("double"), F.coalesce(f"{k}_n0", F.lit(0.0))
        m1, m0 = F.coalesce(f"__{k}_m", F.lit(0.0)), F.coalesce(f"{k}_m0", F.lit(0.0))
        q1, q0 = F.coalesce(F.col(f"__{k}_q") * n1, F.lit(0.0)), F.coalesce(f"{k}_q0", F.lit(0.0))
        n, d = n0 + n1, m1 - m0
        late = F.col(t_us).isNotNull()
        out |= {
            f"{k}_n": F.when(late, n.cast("long")).otherwise(0), f"{k}_m": F.when(late & (n > 0), F.when(n0 == 0, m1).otherwise(m0 + d * n1 / n)),
            f"{k}_s": F.when(late & (n > 1), F.sqrt((q0 + q1 + F.when(n > 0, d * d * n0 * n1 / n).otherwise(0.0)) / (n - 1))), f"{k}_x": F.when(late, F.greatest(F.nanvl(f"{k}_x0", F.lit(None).cast("double")), F.col(f"__{k}_x"))),
            f"{k}_t": F.when(late, F.greatest(F.nanvl(f"{k}_t0", F.lit(None).cast("double")).cast("long"), F.col(f"__{k}_t"))),
        }
    return both.withColumns(out).select(*rows.columns, *out)


def running_total(rows: DataFrame, group: Sequence[str], order: str, amount: str, out: str = "before") -> DataFrame:
    """rows (no two with equal group and order) with the sum of `amount` over those before them in their group.

    Range partitions of (group, order) are the blocks; they are written with their numbers, as another run might cut elsewhere. A group of any size spreads over all of them.
    """
    g = list(group)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(rows.repartitionByRange(n, *g, order).withColumn("__block", F.spark_partition_id()), "ranges")
    sums = cut.groupBy(*g, "__block").agg(F.sum(amount).alias("__sum"))
    along = Window.partitionBy(*g).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    offsets = sums.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(g)], F.col("__block").alias("__gb"), F.coalesce(F.sum("__sum").over(along), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(*g, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    got = _same(cut.withColumn("__own", F.coalesce(F.sum(amount).over(within), F.lit(0))), offsets, {**{c: f"__g{i}" for i, c in enumerate(g)}, "__block": "__gb"}, "inner")
    return got.select(*rows.columns, (F.col("__offset") + F.col("__own")).alias(out))


def places(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, n, before) of the distinct present values: how many rows have it, and how many a smaller one."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return running_total(counts, by, value, "n")


def with_places(rows: DataFrame, found: DataFrame, by: Sequence[str], value: str, keep: Mapping[str, Column]) -> DataFrame:
    """rows with the columns of keep, made of found's (of `places`)."""
    right = found.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate([*by, value])], *[c.alias(n) for n, c in keep.items()])
    return _same(rows, right, {c: f"__p{i}" for i, c in enumerate([*by, value])}, "left")


def average_rank(rows: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Ranks from 1 among present values; equal values share the mean of their ranks."""
    return with_places(rows, places(rows, by, value), by, value, {out: F.col("before") + (F.col("n") + 1) / F.lit(2.0)})


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """(by, and a column for each share): exact quantiles of the present values, between two values linearly. Groups without values have no row."""
    found = places(rows, by, value)
    sizes = found.groupBy(*by).agg(F.sum("n").alias("__size"))
    placed = _same(found, sizes.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], "__size"), {c: f"__g{i}" for i, c in enumerate(by)}, "inner")
    picked, out = [], {}
    for name, share in shares.items():
        place = (F.col("__size") - 1) * F.lit(float(share))
        for side, k in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picked.append(F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value))).alias(f"__{name}_{side}"))
        picked.append(F.max(place - F.floor(place)).alias(f"__{name}_f"))
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out[name] = F.when(lo == hi, lo).otherwise(lo * (1 - F.col(f"__{name}_f")) + hi * F.col(f"__{name}_f"))
    return placed.groupBy(*by).agg(*picked).select(*by, *[c.alias(n) for n, c in out.items()])


def stacked(rows: DataFrame, keep: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """(keep, measure, value): a row for each present measure, so that one scan serves all of them."""
    pairs = F.array(*[F.struct(F.lit(n).alias("measure"), c.cast("double").alias("value")) for n, c in measures.items()])
    return rows.select(*keep, F.explode(pairs).alias("__m")).select(*keep, "__m.measure", "__m.value").where(F.col("value").isNotNull())


def quantile_columns(rows: DataFrame, by: Sequence[str], measures: Mapping[str, Column], shares: Mapping[str, float]) -> DataFrame:
    """(by, and measure_share for each of both)."""
    found = quantiles(stacked(rows, by, measures), [*by, "measure"], "value", shares)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("measure") == m, F.col(s))).alias(f"{m}_{s}") for m in measures for s in shares])
