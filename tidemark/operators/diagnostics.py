"""Descriptive tables per family and symbol. Families are never pooled: each operator groups by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import pearson, ratio
from ..functions.times import ny_date
from .scans import average_rank, quantiles, running_total, with_places


def described(rows: DataFrame, by: Sequence[str], value: str, where: Column | None = None) -> DataFrame:
    """n, mean, std (n - 1), p05, median, p95, min, max of present values; groups without any have n = 0 and nulls."""
    x = F.col(value) if where is None else F.when(where, F.col(value))
    x = F.when(~F.isnan(x), x)
    found = rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    inner = quantiles(rows.select(*by, x.alias("__x")), by, "__x", {"p05": 0.05, "median": 0.5, "p95": 0.95})
    return _joined(found, inner, by).select(*by, "n", "mean", "std", "p05", "median", "p95", "min", "max")


def _joined(groups: DataFrame, more: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row for each group with more's columns, nulls of the key being a group too."""
    met = F.lit(True)
    for k, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"__k{k}"))
    return groups.join(more.withColumnsRenamed({c: f"__k{k}" for k, c in enumerate(by)}), met, "left").drop(*[f"__k{k}" for k in range(len(by))])


def correlations(rows: DataFrame, by: Sequence[str], x: str, y: str, least: int = 3, flat: float | None = None) -> DataFrame:
    """n, distinct x, Pearson and Spearman (Pearson of average ranks) over rows with both; null below `least` rows, `flat` without variation."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = average_rank(average_rank(both, by, x, "__rx"), by, y, "__ry")
    out = both.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(x).alias("ux"), F.count_distinct(y).alias("uy"), pearson(x, y).alias("p"), pearson("__rx", "__ry").alias("s"))
    varied = (F.col("ux") > 1) & (F.col("uy") > 1)
    valid = lambda c: F.when(F.col("n") >= least, F.when(varied, F.col(c)).otherwise(F.lit(flat)))
    return out.select(*by, "n", F.col("ux").alias("unique_x"), valid("p").alias("pearson"), valid("s").alias("spearman"))


def by_sign(rows: DataFrame, by: Sequence[str], sign: str, value: str) -> DataFrame:
    known = rows.where(F.col(sign).isNotNull() & F.col(value).isNotNull())
    found = known.groupBy(*by, sign).agg(F.count("*").alias("n"), F.avg(value).alias("mean_ret"))
    return _joined(found, quantiles(known, [*by, sign], value, {"median_ret": 0.5}), [*by, sign])


def tie_safe_bins(rows: DataFrame, by: Sequence[str], value: str, requested: int = 5, out: str = "bin") -> DataFrame:
    """Bins over the distinct values, so ties never part; the first bins take the remainder. Groups with one distinct value have none (null)."""
    distinct = rows.where(F.col(value).isNotNull()).select(*by, value).distinct().withColumn("__one", F.lit(1))
    d = running_total(distinct, by, value, "__one", "__p").drop("__one")
    sizes = d.groupBy(*by).agg(F.count("*").alias("__n"))
    d = _joined(d, sizes, by).withColumn("__k", F.least(F.lit(requested), F.col("__n")))
    size, more = F.floor(F.col("__n") / F.col("__k")), F.pmod(F.col("__n"), F.col("__k"))
    edge = more * (size + 1)
    bin_ = F.when(F.col("__p") < edge, F.floor(F.col("__p") / (size + 1))).otherwise(more + F.floor((F.col("__p") - edge) / size)) + 1
    d = d.select(*by, value, F.when(F.col("__n") >= 2, bin_.cast("int")).alias(out), F.when(F.col("__n") >= 2, F.col("__k")).otherwise(0).cast("int").alias("actual_bins"), F.col("__n").alias("unique_values"))
    return with_places(rows, d, by, value, {c: F.col(c) for c in (out, "actual_bins", "unique_values")}).where(F.col(value).isNotNull())


def bin_table(rows: DataFrame, by: Sequence[str], x: str, y: str, requested: int = 5, skip: Column | None = None) -> DataFrame:
    """n, least and greatest x and mean y of each bin; groups that are to be skipped, or have fewer than `requested` distinct x, have one row with the reason."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    groups = both.groupBy(*by).agg(F.count_distinct(x).alias("__u"), F.count("*").alias("__c"), F.bool_or(F.lit(False) if skip is None else skip).alias("__weak"))
    reason = F.when(F.col("__weak"), "weak_surprise_proxy").when(F.col("__u") < requested, "insufficient_distinct_raw_surprises")
    groups = groups.withColumn("skipped_reason", reason)
    binned = tie_safe_bins(both.join(groups.where("skipped_reason is null and __c >= 3").select(*by), list(by), "left_semi"), by, x, requested)
    made = binned.where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"), F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.avg(y).alias("mean_y"), F.max("actual_bins").alias("actual_bins"))
    skipped = groups.where("skipped_reason is not null").select(*by, F.col("__c").alias("n"), "skipped_reason", F.lit(0).alias("actual_bins"))
    return made.unionByName(skipped, allowMissingColumns=True)


def baseline_evaluation(rows: DataFrame, by: Sequence[str], observed: str, residual: str, where: Column, cutoff_us: str | None = None, split_start: Column | None = None) -> DataFrame:
    """Mean squares of observed returns and residuals in squared basis points, and how many predictions used history of the same split."""
    used = rows.where(where)
    square = lambda c: (F.avg(F.col(c) * F.col(c)) * 1e8)
    more = [] if cutoff_us is None else [F.count_if(ny_date(F.timestamp_micros(cutoff_us)) >= split_start).alias("predictions_using_same_split_history")]
    return used.groupBy(*by).agg(F.count("*").alias("n"), square(observed).alias("ms_observed_bp2"), square(residual).alias("ms_residual_bp2"), *more)


def status_pivot(rows: DataFrame, by: Sequence[str], status: str, values: Sequence[str]) -> DataFrame:
    """Counts of each status as columns; the list of values is explicit, so no extra pass finds them."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values])


def status_counts(rows: DataFrame, *status: str) -> DataFrame:
    return rows.groupBy(*status).agg(F.count("*").alias("n"))


def quality_table(wide: DataFrame, horizons: Sequence[int] = (1, 5, 30, 60)) -> DataFrame:
    """Per family and symbol: how many releases are usable, have values, surprises and responses, and why others do not."""
    usable = F.col("event_status") == "usable"
    ok = lambda h: usable & F.col(f"post{h}m_status").isin("ok", "ok_market_halt") & F.col(f"post{h}m_ret").isNotNull()
    n = F.count_if
    gap = F.lit(False)
    for h in horizons:
        gap = gap | (F.col(f"post{h}m_status") == "provider_gap_in_window")
    return wide.groupBy("event_family", "symbol").agg(
        F.count("*").alias("releases"), n(usable).alias("usable_events"), n(F.col("forecast").isNotNull()).alias("with_forecast"), n(F.col("actual").isNotNull()).alias("with_actual"),
        n(usable & F.col("surprise_raw").isNotNull()).alias("valid_surprise"), n(usable & (F.col("surprise_std_status") == "ok") & F.col("surprise_std").isNotNull()).alias("valid_std_surprise"),
        n(usable & (F.col("surprise_raw") != 0)).alias("nonzero_surprises"), *[n(ok(h)).alias(f"valid_post{h}m") for h in horizons], n(usable & gap).alias("provider_gap_exclusions"),
        n(usable & F.col("any_market_halt")).alias("market_halt_tagged"), n(usable & (F.col("release_session_state") == "premarket") & (F.col("post5m_status") == "insufficient_market_window")).alias("insufficient_premarket_post5m"),
        n(usable & (F.col("post5m_status") == "exchange_closed")).alias("exchange_closed"), n(F.col("event_status") == "after_research_end").alias("provisional_exclusions"),
        n(F.col("event_status").startswith("excluded_")).alias("ambiguous_timestamp_exclusions"), n(F.col("event_status") == "unscheduled_release").alias("unscheduled_exclusions"),
    )


def counts_by(rows: DataFrame, row: str, column: Column, values: Sequence[str]) -> DataFrame:
    """Counts as a pivot over explicit values, 0 where there are none."""
    return rows.withColumn("__c", column).groupBy(row).pivot("__c", list(values)).count().na.fill(0)
