"""The whole study: events, surprises, release windows, baselines, diagnostics, as one lazy plan.

events -> status and concurrency -> surprises and causal z-scores; releases x symbols -> windows -> exclusion carried into them -> wide table by
an explicit pivot -> split, walk-forward baseline -> tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..functions.times import split_of
from ..operators import diagnostics, events, history, response
from ..operators.windows import METRICS, WindowSpec, release_windows


@dataclass(frozen=True)
class Family:
    name: str
    group: str
    frequency: str
    publisher: str
    times: tuple[str, ...] = ("08:30",)
    relative: bool = False
    weak_proxy: bool = False


#: The families, their documented New York release times and what their surprises measure.
FAMILIES = {
    "CPI_MOM": Family("CPI m/m", "CPI", "monthly", "BLS"),
    "CPI_YOY": Family("CPI y/y", "CPI", "monthly", "BLS"),
    "CORE_CPI_MOM": Family("Core CPI m/m", "CPI", "monthly", "BLS"),
    "CORE_CPI_YOY": Family("Core CPI y/y", "CPI", "monthly", "BLS"),
    "NFP": Family("Nonfarm Payrolls", "EMPLOYMENT", "monthly", "BLS", relative=True),
    "UNEMPLOYMENT_RATE": Family("Unemployment Rate", "EMPLOYMENT", "monthly", "BLS"),
    "AVG_HOURLY_EARNINGS_MOM": Family("Average Hourly Earnings m/m", "EMPLOYMENT", "monthly", "BLS"),
    "CORE_PCE_MOM": Family("Core PCE Price Index m/m", "PCE", "monthly", "BEA", ("08:30", "10:00")),
    "GDP_ADVANCE_QOQ": Family("GDP q/q (advance)", "GDP", "quarterly", "BEA"),
    "GDP_PRELIM_QOQ": Family("GDP q/q (second estimate)", "GDP", "quarterly", "BEA"),
    "GDP_FINAL_QOQ": Family("GDP q/q (third estimate)", "GDP", "quarterly", "BEA"),
    "FED_FUNDS_RATE": Family("FOMC policy rate decision (federal funds target, upper bound)", "FOMC", "scheduled_meetings", "FOMC", ("14:00",), weak_proxy=True),
}
#: Calendar labels of the families (label, family, bundle, unit, and the unit and multiplier rule of the export).
LABELS = (
    ("CPI m/m", "CPI_MOM", "CPI", "PERCENT"), ("CPI y/y", "CPI_YOY", "CPI", "PERCENT"), ("Core CPI m/m", "CORE_CPI_MOM", "CPI", "PERCENT"), ("Core CPI y/y", "CORE_CPI_YOY", "CPI", "PERCENT"),
    ("Nonfarm Payrolls", "NFP", "EMPLOYMENT", "THOUSANDS"), ("Non-Farm Employment Change", "NFP", "EMPLOYMENT", "THOUSANDS"), ("Unemployment Rate", "UNEMPLOYMENT_RATE", "EMPLOYMENT", "PERCENT"),
    ("Average Hourly Earnings m/m", "AVG_HOURLY_EARNINGS_MOM", "EMPLOYMENT", "PERCENT"), ("Core PCE Price Index m/m", "CORE_PCE_MOM", "PCE", "PERCENT"), ("Advance GDP q/q", "GDP_ADVANCE_QOQ", "GDP", "PERCENT"),
    ("Prelim GDP q/q", "GDP_PRELIM_QOQ", "GDP", "PERCENT"), ("Final GDP q/q", "GDP_FINAL_QOQ", "GDP", "PERCENT"), ("Federal Funds Rate", "FED_FUNDS_RATE", "FOMC", "PERCENT"),
)
SPLITS = {"development": ("2016-01-01", "2020-12-31"), "validation": ("2021-01-01", "2022-12-31"), "test": ("2023-01-01", "2026-09-30")}


@dataclass(frozen=True)
class StudySpec:
    families: dict[str, Family] = field(default_factory=lambda: dict(FAMILIES))
    splits: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(SPLITS))
    research_end: str = "2026-09-30"
    windows: WindowSpec = WindowSpec()
    min_history: int = 12
    tolerance: float = 1e-9
    baseline_horizons: Sequence[int] = (1, 5, 15, 30, 60)
    baseline_min: int = 8
    policy_family: str = "FED_FUNDS_RATE"


def family_frame(spark: SparkSession, spec: StudySpec) -> DataFrame:
    rows = [(k, f.name, f.group, f.frequency, f.publisher, list(f.times), f.relative, "weak_surprise_proxy" if f.weak_proxy else "calendar_forecast_surprise") for k, f in spec.families.items()]
    return spark.createDataFrame(rows, "event_family string, event_name string, family_group string, frequency string, publisher string, expected_release_times_et array<string>, relative boolean, surprise_measure_quality string")


def label_frame(spark: SparkSession) -> DataFrame:
    rows = [(label.lower(), family, label, bundle, unit, "JOB" if family == "NFP" else None, "THOUSANDS" if family == "NFP" else None) for label, family, bundle, unit in LABELS]
    return spark.createDataFrame(rows, "label_key string, event_family string, indicator string, release_bundle string, value_unit string, rule_unit string, rule_multiplier string")


def event_table(calendar: DataFrame, spec: StudySpec, official: DataFrame | None = None) -> DataFrame:
    """One row per calendar event of the families: status, concurrency, official comparison, surprises."""
    spark = calendar.sparkSession
    families = family_frame(spark, spec)
    e = calendar.withColumnRenamed("provider_forecast", "forecast").join(F.broadcast(families.drop("expected_release_times_et")), "event_family")
    e = events.with_release_status(e, families, spec.research_end, spec.policy_family)
    if official is not None:
        e = events.with_official(e, official)
    e = history.with_surprise(e, relative=F.col("relative")).withColumn("t_us", F.unix_micros("release_timestamp_utc"))
    missing = history.surprise_status(F.col("actual"), F.col("forecast"))
    z = history.causal_zscore(e, ["event_family"], "t_us", "surprise_raw", events.usable_event(), missing, spec.min_history, spec.tolerance)
    return z.drop("relative")


def excluded(windows: DataFrame, release_events: DataFrame) -> DataFrame:
    """Windows of releases without any usable event: status event_excluded, features null."""
    state = release_events.groupBy("release_id").agg(F.bool_or(events.usable_event()).alias("__any"))
    w = windows.join(state, "release_id", "left")
    gone = ~F.coalesce("__any", F.lit(False)) & (F.col("status") != "no_release_time")
    made = {m: F.when(~gone, F.col(m)) for m in METRICS} | {"status": F.when(gone, "event_excluded").otherwise(F.col("status"))}
    return w.withColumns(made).drop("__any")


def wide(event_rows: DataFrame, windows: DataFrame, symbols: Sequence[str], spec: StudySpec) -> DataFrame:
    """A row for each event and symbol with every window's metrics as columns; without a release time all statuses are no_release_time."""
    names = [n for n, _, _ in spec.windows.all()]
    cells = ("status", "coverage", *METRICS, "volume_rel_status", "volume_rel_n_windows")
    p = windows.groupBy("release_id", "symbol").pivot("window", names).agg(*[F.first(c).alias(c) for c in cells])
    whole = windows.groupBy("release_id", "symbol").agg(
        F.bool_or("has_market_halt").alias("any_market_halt"), F.bool_or("has_provider_gap").alias("any_provider_gap"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("exception_ids")))).alias("exception_ids"), F.first("release_session_state").alias("release_session_state"),
    )
    e = response.all_pairs(event_rows, symbols)
    w = e.join(p, ["release_id", "symbol"], "left").join(whole, ["release_id", "symbol"], "left")
    w = w.withColumns({f"{n}_status": F.coalesce(f"{n}_status", F.lit("no_release_time")) for n in names} | {"any_market_halt": F.coalesce("any_market_halt", F.lit(False)), "any_provider_gap": F.coalesce("any_provider_gap", F.lit(False))})
    if "post5m" in names and "post60m" in names:
        w = w.withColumn("concentration_v5_v60", ratio(F.col("post5m_volume"), F.col("post60m_volume")))
    return w.withColumn("split", split_of(F.col("release_timestamp_utc"), spec.splits))


def study(calendar: DataFrame, bars: DataFrame, sessions: DataFrame, registry: DataFrame, symbols: Sequence[str], spec: StudySpec = StudySpec(), official: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, wide, windows). bars: symbol, timestamp_utc, high, low, close, volume. All lazy."""
    e = event_table(calendar, spec, official)
    releases = response.all_pairs(e.where("release_id is not null").select("release_id", F.col("release_id").alias("release_ts")).distinct(), symbols)
    w = excluded(release_windows(releases, bars, sessions, registry, spec.windows, spec.research_end), e)
    rows = wide(e, w, symbols, spec)
    horizons = [(f"post{h}m_ret", f"post{h}m_ret", events.usable_response(f"post{h}m")) for h in spec.baseline_horizons]
    rows = history.expanding_baseline(rows, ["symbol", "event_family"], "t_us", "surprise_sign", horizons, spec.baseline_min)
    return e, rows, w


def report(rows: DataFrame, windows: DataFrame, spec: StudySpec = StudySpec()) -> dict[str, DataFrame]:
    """The descriptive tables: quality, statuses, correlations, signs, bins, distributions, baseline evaluation."""
    by = ["event_family", "symbol"]
    std = F.when(events.usable_std_surprise(), F.col("surprise_std"))
    out = {"quality": diagnostics.quality_table(rows), "window_status": diagnostics.status_counts(windows, "status"), "event_status": diagnostics.status_counts(rows.select("event_family", "event_id", "event_status").distinct(), "event_family", "event_status")}
    starts = F.lit(None).cast("date")
    for name, (first, _) in spec.splits.items():
        starts = F.when(F.col("split") == name, F.lit(first).cast("date")).otherwise(starts)
    parts: dict[str, list[DataFrame]] = {"correlation": [], "by_sign": [], "bins": [], "distribution": [], "baseline": []}
    parts["distribution"] += [diagnostics.described(rows, by, "surprise_raw", events.usable_event()).withColumn("quantity", F.lit("surprise_raw")), diagnostics.described(rows, by, "surprise_std", events.usable_std_surprise()).withColumn("quantity", F.lit("surprise_std"))]
    for h in spec.baseline_horizons:
        y = f"post{h}m_ret"
        ok = events.usable_response(f"post{h}m")
        r = rows.withColumns({"__x": F.when(ok, std), "__y": F.when(ok, F.col(y)), "__weak": F.col("surprise_measure_quality") == "weak_surprise_proxy"})
        tag = lambda df, h=h: df.withColumn("horizon_min", F.lit(h))
        parts["correlation"].append(tag(diagnostics.correlations(r, by, "__x", "__y")))
        parts["by_sign"].append(tag(diagnostics.by_sign(r, by, "surprise_sign", "__y")))
        parts["bins"].append(tag(diagnostics.bin_table(r, by, "__x", "__y", skip=F.col("__weak"))))
        parts["distribution"].append(diagnostics.described(r, by, "__y").withColumn("quantity", F.lit(y)))
        parts["baseline"].append(tag(diagnostics.baseline_evaluation(rows.withColumn("__s", starts), ["split", *by], y, f"resid_{y}", ok & (F.col(f"baseline_{y}_status") == "ok"), f"baseline_{y}_training_cutoff_us", F.col("__s"))))
    for name, frames in parts.items():
        whole = frames[0]
        for x in frames[1:]:
            whole = whole.unionByName(x, allowMissingColumns=True)
        out[name] = whole
    return out
