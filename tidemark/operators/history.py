"""Statistics from strictly earlier history: causal z-scores and expanding means.

History is a scan in two levels (scans.earlier): states of days are merged along a group, and a window frame from the day's start to one microsecond before the row adds the rest, so equal
instants never see each other and no task holds a group. Eligibility sits inside the aggregates, so rows that may not serve as history still get theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import coalesced_status, ratio
from .scans import earlier


def raw_surprise(actual: Column, forecast: Column) -> Column:
    """actual - forecast to 10 digits, halves to even; null if either is missing."""
    return F.bround((actual - forecast).cast("double"), 10)


def surprise_status(actual: Column, forecast: Column) -> Column:
    return F.when(forecast.isNull(), "missing_forecast").when(actual.isNull(), "missing_actual")


def with_surprise(events: DataFrame, actual: str = "actual", forecast: str = "forecast", relative: Column | None = None) -> DataFrame:
    """surprise_raw, surprise_sign, surprise_relative and its status. relative: whether a ratio to the forecast means anything for the row."""
    a, f = F.col(actual), F.col(forecast)
    raw, missing = raw_surprise(a, f), surprise_status(a, f)
    relative = F.lit(False) if relative is None else relative
    status = F.when(missing.isNotNull(), missing).when(~relative, "not_meaningful_for_family").when(~(f > 0), "forecast_not_positive").otherwise("ok")
    return events.withColumns({
        "surprise_raw": raw, "surprise_sign": F.signum(raw).cast("int"), "surprise_relative": F.when(status == "ok", ratio(raw, f)), "surprise_relative_status": status,
    })


def causal_zscore(
    events: DataFrame, group: Sequence[str], t_us: str, value: str, usable: Column, missing: Column | None = None, min_history: int = 12, tolerance: float = 1e-9, prefix: str = "surprise_std"
) -> DataFrame:
    """(value - mean) / std of the usable, present values strictly earlier in the group, with n, mean, std, last instant and status.

    Status: the row's own missing status, event_excluded, insufficient_history, zero_historical_dispersion (std within the tolerance of the
    largest earlier size, at least 1), ok. Rows that have no value or are not usable have no history columns.
    """
    v = F.col(value)
    in_history = F.when(usable & v.isNotNull(), v)
    asks = v.isNotNull() & usable & F.col(t_us).isNotNull()
    stats = earlier(events, group, t_us, {"_": in_history})
    stats = stats.withColumnsRenamed({f"__{s}": f"__hist_{s}" for s in "nmsxt"})
    enough = F.col("__hist_n") >= min_history
    flat = F.col("__hist_s").isNull() | F.isnan("__hist_s") | (F.col("__hist_s") <= tolerance * F.greatest(F.lit(1.0), F.col("__hist_x")))
    status = coalesced_status(
        (v.isNull(), "missing"),
        (~asks, "event_excluded"),
        (~enough, "insufficient_history"),
        (flat, "zero_historical_dispersion"),
        otherwise="ok",
    )
    own = F.when(v.isNull(), F.coalesce(missing, F.lit("missing_value")) if missing is not None else F.lit("missing_value")).otherwise(status)
    return stats.withColumns({
        prefix: F.when(own == "ok", ratio(v - F.col("__hist_m"), F.col("__hist_s"))),
        f"{prefix}_status": own,
        f"{prefix}_n_history": F.when(asks, F.col("__hist_n")),
        f"{prefix}_hist_mean": F.when(asks & enough, F.col("__hist_m")),
        f"{prefix}_hist_std": F.when(asks & enough, F.col("__hist_s")),
        f"{prefix}_history_through_us": F.when(asks, F.col("__hist_t")),
    }).drop(*[f"__hist_{s}" for s in "nmsxt"])


def expanding_baseline(
    rows: DataFrame, group: Sequence[str], t_us: str, sign: str, responses: Sequence[tuple[str, str, Column]], min_history: int = 8
) -> DataFrame:
    """For each (name, value column, usable): the mean of the usable values strictly earlier in (group, sign), and what is left of the row's own.

    Excluded or unobserved rows still get their expectation, with status no_observed_response. One scan serves all responses.
    """
    out = rows.withColumn("__sign", F.coalesce(F.col(sign).cast("string"), F.lit("none")))
    known = (F.col("__sign") != "none") & F.col(t_us).isNotNull()
    out = earlier(out, [*group, "__sign"], t_us, {f"__h{k}": F.when(usable, F.col(value)) for k, (_, value, usable) in enumerate(responses)})
    over = [f"__h{k}_{s}" for k in range(len(responses)) for s in "nmsxt"]
    made = {}
    for k, (name, value, usable) in enumerate(responses):
        n = F.col(f"__h{k}_n")
        observed = usable & F.col(value).isNotNull()
        status = coalesced_status((~known, "no_surprise_sign"), (n < min_history, "insufficient_history"), (~F.coalesce(observed, F.lit(False)), "no_observed_response"), otherwise="ok")
        expected = F.when(known & (n >= min_history), F.col(f"__h{k}_m"))
        made |= {
            f"expected_{name}": expected,
            f"resid_{name}": F.when(status == "ok", F.col(value) - expected),
            f"baseline_{name}_n_history": F.when(known, n),
            f"baseline_{name}_training_cutoff_us": F.when(known, F.col(f"__h{k}_t")),
            f"baseline_{name}_status": status,
        }
    return out.withColumns(made).drop("__sign", *over)
