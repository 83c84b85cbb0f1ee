"""Release-aligned response windows over bars.

A bar stamped T covers [T, T + step). `post h` is measured against the close of the bar before the release bar and takes the bars
t .. t+h-1; `pre k` against the bar t-k-1 and takes t-k .. t-1, where t is the release time cut down to the step.

A release meets its bars by an equi-join: its windows' bar starts are spelt out (235 for the standard windows) and joined on
(symbol, start). The releases are the small side, so the bars are not moved when they are few enough to
be broadcast, and are shuffled once by that key otherwise. No range join takes place.

Nothing is filled: a window's features exist only if its anchor and every expected bar do, and each null has a status.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import coalesced_status, ln, ratio
from ..functions.times import DAY_US, MINUTE_US, NY, long, ny_date, session_state
from ..sources.registry import NOT_EXPECTED, met, query_windows

METRICS = ("ret", "logret", "high_exc", "low_exc", "mfe", "mae", "range", "rv_abs", "rv_sq", "volume", "volume_rel")


@dataclass(frozen=True)
class WindowSpec:
    pre: Sequence[int] = (60, 30, 15, 5, 1)
    post: Sequence[int] = (1, 2, 5, 15, 30, 60)
    step_us: int = MINUTE_US
    baseline_sessions: int = 20
    baseline_min: int = 10
    baseline_lookback: int = 60

    def all(self) -> list[tuple[str, str, int]]:
        return [*((f"pre{k}m", "pre", k) for k in self.pre), *((f"post{h}m", "post", h) for h in self.post)]

    def offsets(self) -> list[tuple[str, str, int, int]]:
        """(window, side, first offset, last offset); the anchor is one before the first."""
        return [(name, side, 0 if side == "post" else -n, n - 1 if side == "post" else -1) for name, side, n in self.all()]


def spelt_out(releases: DataFrame, spec: WindowSpec, t_us: str = "t_us") -> DataFrame:
    """releases with window, side, minutes, offset, is_anchor, bar_us: a row for each bar that a window needs."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("window"), F.lit(side).alias("side"), F.lit(last - first + 1).alias("minutes"), F.lit(first).alias("first"), F.lit(last).alias("last"))
        for name, side, first, last in spec.offsets()
    ])
    w = releases.withColumn("w", F.explode(rows)).select(*releases.columns, "w.*")
    w = w.withColumn("offset", F.explode(F.sequence(F.col("first") - 1, F.col("last"))))
    start = F.col(t_us) - F.pmod(F.col(t_us), long(spec.step_us))
    return w.select(*releases.columns, "window", "side", "minutes", "offset", (F.col("offset") < F.col("first")).alias("is_anchor"), (start + F.col("offset") * long(spec.step_us)).alias("bar_us"))


def measured(probes: DataFrame, bars: DataFrame, key: Sequence[str], symbol: str = "symbol") -> DataFrame:
    """One row for each key and window: counts of expected and observed bars and, where none is missing, all metrics but volume_rel.

    probes: spelt_out rows, with a boolean `due` (false: no bar is expected there). bars: symbol, bar_us, high, low, close, volume.
    """
    b = bars.select(F.col(symbol).alias("b_symbol"), F.col("bar_us").alias("b_us"), "high", "low", "close", "volume")
    rows = probes.join(b, (F.col(symbol) == F.col("b_symbol")) & (F.col("bar_us") == F.col("b_us")), "left")
    keys = [*key, "window", "side", "minutes"]
    inside = F.col("due") | F.col("is_anchor")
    before = F.lag("close").over(Window.partitionBy(*keys).orderBy("offset"))
    rows = rows.where(inside).withColumn("r", F.when(~F.col("is_anchor"), ln(ratio(F.col("close"), before))))
    bar = lambda c: F.when(~F.col("is_anchor"), c)
    seen = F.col("b_us").isNotNull()
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_expected_bars"),
        F.count_if(seen).alias("n_observed_bars"),
        F.count_if(~F.col("is_anchor")).alias("n_due"),
        F.max(F.when(F.col("is_anchor"), F.col("close"))).alias("anchor"),
        F.max_by(bar(F.col("close")), bar(F.col("offset"))).alias("c_last"),
        F.max(bar(F.col("high"))).alias("h"),
        F.min(bar(F.col("low"))).alias("l"),
        F.sum(F.abs("r")).alias("rv_abs"),
        F.sum(F.col("r") * F.col("r")).alias("rv_sq"),
        F.sum(bar(F.col("volume"))).alias("volume"),
        F.min(bar(F.col("bar_us"))).alias("first_due_us"),
        F.max(bar(F.col("bar_us"))).alias("last_due_us"),
    )
    out = out.withColumn("complete", (F.col("n_observed_bars") == F.col("n_expected_bars")) & (F.col("n_due") > 0))
    ret = ratio(F.col("c_last"), F.col("anchor")) - 1
    high, low = ratio(F.col("h"), F.col("anchor")) - 1, ratio(F.col("l"), F.col("anchor")) - 1
    made = {
        "ret": ret,
        "logret": F.ln(ratio(F.col("c_last"), F.col("anchor"))),
        "high_exc": high,
        "low_exc": low,
        "mfe": F.when(ret > 0, high).when(ret < 0, -low),
        "mae": F.when(ret > 0, F.greatest(F.lit(0.0), -low)).when(ret < 0, F.greatest(F.lit(0.0), high)),
        "range": ratio(F.col("h") - F.col("l"), F.col("anchor")),
    }
    made |= {m: F.col(m) for m in ("rv_abs", "rv_sq", "volume")}
    out = out.withColumns({m: F.when(F.col("complete"), c) for m, c in made.items()})
    return out.withColumn("coverage", ratio(F.col("n_observed_bars"), F.col("n_expected_bars"))).drop("anchor", "c_last", "h", "l")


def with_due(probes: DataFrame, registry: DataFrame | None, provider: str, feed: str) -> DataFrame:
    """due: false for bars inside intervals in which none is expected."""
    if registry is None:
        return probes.withColumn("due", F.lit(True))
    points, at = probes.select("symbol", "bar_us").distinct(), F.col("bar_us")
    hit = met(points, registry.where(F.col("classification").isin(*NOT_EXPECTED)), F.col("symbol"), at, at + 1, provider, feed, "left_semi").distinct().withColumn("off", F.lit(True))
    return probes.join(hit, ["symbol", "bar_us"], "left").withColumn("due", ~F.coalesce("off", F.lit(False))).drop("off")


def measured_at_starts(releases: DataFrame, bars: DataFrame, key: Sequence[str], spec: WindowSpec, due: Callable[[DataFrame], DataFrame] | None = None, t_us: str = "t_us") -> DataFrame:
    """measured for releases (key with symbol, t_us), and `start_us`, the release bar's start.

    Windows depend on the symbol and that start alone, so they are spelt out and measured once for all releases that share both (the releases of a bundle, or of a day where bars are
    days), and a release meets them by equality.
    """
    begun = releases.withColumn("start_us", F.col(t_us) - F.pmod(F.col(t_us), long(spec.step_us)))
    probes = spelt_out(begun.select("symbol", "start_us").distinct(), spec, "start_us")
    found = measured(probes.withColumn("due", F.lit(True)) if due is None else due(probes), bars, ["symbol", "start_us"])
    return begun.select(*key, "start_us").join(found, ["symbol", "start_us"])


def release_windows(
    releases: DataFrame, bars: DataFrame, sessions: DataFrame, registry: DataFrame, spec: WindowSpec = WindowSpec(), research_end: str = "9999-12-31", provider: str = "alpaca", feed: str = "sip"
) -> DataFrame:
    """A row for each (release, symbol, window).

    releases: release_id, symbol, release_ts (instant, may be null). bars: symbol, timestamp_utc, high, low, close, volume.
    status: no_release_time, provider_gap_in_window, exchange_closed, provisional_market_data, insufficient_market_window, ok_market_halt, ok; the first that holds.
    """
    key = ["release_id", "symbol"]
    timed = releases.where("release_ts is not null").withColumn("t_us", F.unix_micros("release_ts"))
    b = bars.withColumn("bar_us", F.unix_micros("timestamp_utc"))
    found = measured_at_starts(timed.select(*key, "t_us"), b, key, spec, lambda probes: with_due(probes, registry, provider, feed))
    grid = timed.select(*key, "release_ts", "t_us").withColumn("w", F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.lit(a).alias("first"), F.lit(z).alias("last")) for n, _, a, z in spec.offsets()])))
    start = F.col("t_us") - F.pmod(F.col("t_us"), long(spec.step_us))
    grid = grid.select(
        *key, "release_ts", (start == F.col("t_us")).alias("release_timestamp_minute_aligned"), "w.window", F.timestamp_micros(start + (F.col("w.first") - 1) * long(spec.step_us)).alias("anchor_bar_utc"),
        F.timestamp_micros(start + F.col("w.first") * long(spec.step_us)).alias("first_bar_utc"), F.timestamp_micros(start + F.col("w.last") * long(spec.step_us)).alias("last_bar_utc"),
        F.timestamp_micros(start + (F.col("w.last") + 1) * long(spec.step_us)).alias("span_end"),
    )
    met = query_windows(grid.select(*key, "window", "anchor_bar_utc", "span_end"), registry, [*key, "window"], "anchor_bar_utc", "span_end", provider, feed)
    day = sessions.select(F.col("ny_date").alias("s_date"), F.col("open").alias("s_open"), F.col("close").alias("s_close"))
    rows = grid.join(day, ny_date(F.col("release_ts")) == F.col("s_date"), "left").join(met, [*key, "window"]).join(found, [*key, "window"], "left")
    state = session_state(F.col("release_ts"), F.col("s_open"), F.col("s_close"))
    complete = F.coalesce("complete", F.lit(False))
    status = coalesced_status(
        (F.col("has_provider_gap"), "provider_gap_in_window"),
        ((state == "closed_day") | F.col("has_exchange_closed"), "exchange_closed"),
        (ny_date(F.col("last_bar_utc")) > F.lit(research_end).cast("date"), "provisional_market_data"),
        (~complete, "insufficient_market_window"),
        (F.col("has_market_halt"), "ok_market_halt"),
        otherwise="ok",
    )
    rows = rows.withColumn("release_session_state", state).withColumn("status", status).withColumn("release_bar_straddles_release", ~F.col("release_timestamp_minute_aligned"))
    usable = F.col("status").isin("ok", "ok_market_halt")
    rows = rows.withColumns({m: F.when(usable, F.col(m)) for m in METRICS if m != "volume_rel"})
    # as the windows themselves, their baselines are those of the symbol and the start
    shared = rows.where(usable).select(F.col("start_us").alias("release_id"), "symbol", "window", "first_due_us", "last_due_us", "n_due", "volume").dropDuplicates(["release_id", "symbol", "window"])
    rel = volume_baseline(shared, b, sessions, registry, spec, provider, feed).withColumnRenamed("release_id", "start_us")
    rel = rel.withColumnsRenamed({c: f"__{c}" for c in ("volume_rel", "volume_rel_status", "volume_rel_n_windows")})
    rows = rows.join(rel, ["start_us", "symbol", "window"], "left")
    rows = rows.withColumns({c: F.when(usable, F.col(f"__{c}")) for c in ("volume_rel", "volume_rel_status", "volume_rel_n_windows")}).drop("__volume_rel", "__volume_rel_status", "__volume_rel_n_windows")
    rows = rows.drop("span_end", "s_date", "s_open", "s_close", "has_exchange_closed", "invalidated", "first_due_us", "last_due_us", "n_due", "complete", "release_ts", "start_us")
    untimed = releases.where("release_ts is null").select("release_id", "symbol", F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.lit(s).alias("side"), F.lit(k).alias("minutes")) for n, s, k in spec.all()])).alias("w"))
    untimed = untimed.select("release_id", "symbol", "w.*", F.lit("no_release_time").alias("status"))
    return rows.unionByName(untimed, allowMissingColumns=True)


def label_counts(start_us: Column, n: Column, open_us: Column, close_us: Column, step_us: int) -> tuple[Column, Column]:
    """Bars before the open, and before the close, of n bars from start. As labels only change at open and close, equal counts are equal label sequences."""
    before = lambda edge: F.greatest(F.lit(0), F.least(n, F.ceil((edge - start_us) / F.lit(step_us)))).cast("long")
    return before(open_us), before(close_us)


def range_sums(ranges: DataFrame, bars: DataFrame, key: Sequence[str], from_us: str, to_us: str, step_us: int) -> DataFrame:
    """(key, m, v) of ranges on the bars' grid that have their first and last bar: the number of bars and the sum of their volumes.

    Bars carry running counts and sums within their UTC day and place on the step's grid, so the windows are a day of a symbol each. A range is cut at midnights, mostly nowhere, and each
    piece looks up its first and its last bar by equality; a range with a piece that lacks either has no row (it lacks bars), so rows grow with ranges and not with the bars in them.
    """
    day = lambda c: F.floor(c / long(DAY_US))
    run = Window.partitionBy("b_symbol", "b_day", "b_place").orderBy("b_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = bars.select(F.col("symbol").alias("b_symbol"), F.col("bar_us").alias("b_us"), day(F.col("bar_us")).alias("b_day"), F.pmod(F.col("bar_us"), long(step_us)).alias("b_place"), F.coalesce("volume", F.lit(0.0)).alias("b_v"))
    b = b.withColumns({"b_m": F.count("*").over(run), "b_sum": F.sum("b_v").over(run)}).select("b_symbol", "b_us", "b_v", "b_m", "b_sum")
    last = F.col(to_us) - step_us
    pieces = ranges.withColumn("__day", F.explode(F.sequence(day(F.col(from_us)), day(last))))
    low, high = F.col("__day") * long(DAY_US), (F.col("__day") + 1) * long(DAY_US)
    a = F.greatest(F.col(from_us), low + F.pmod(-(low - F.col(from_us)), long(step_us)))
    z = F.least(last, F.col(from_us) + F.floor((high - 1 - F.col(from_us)) / long(step_us)) * long(step_us))
    pieces = pieces.withColumns({"__a": a, "__z": z}).where("__a <= __z")
    ends = pieces.withColumn("__end", F.explode(F.array(F.struct(F.col("__a").alias("us"), F.lit(-1).alias("sign")), F.struct(F.col("__z").alias("us"), F.lit(1).alias("sign")))))
    got = ends.join(b, (F.col("symbol") == F.col("b_symbol")) & (F.col("__end.us") == F.col("b_us")), "left")
    opening = F.col("__end.sign") < 0
    m = F.when(opening, 1 - F.col("b_m")).otherwise(F.col("b_m"))
    v = F.when(opening, F.col("b_v") - F.col("b_sum")).otherwise(F.col("b_sum"))
    return got.groupBy(*key).agg(F.sum(m).alias("m"), F.sum(v).alias("v"), F.count_if(F.col("b_m").isNull()).alias("__lost")).where("__lost = 0").drop("__lost")


def volume_baseline(windows: DataFrame, bars: DataFrame, sessions: DataFrame, registry: DataFrame, spec: WindowSpec, provider: str = "alpaca", feed: str = "sip") -> DataFrame:
    """(release_id, symbol, window, volume_rel, volume_rel_status, volume_rel_n_windows).

    Candidates are the same wall-clock bars on up to baseline_lookback earlier sessions. Valid ones have the same sequence of session labels, meet no
    registered exception and have every bar; the latest baseline_sessions of them are averaged. A candidate's sum is two look-ups of running sums, not a row for each of its bars.
    """
    key = ["release_id", "symbol", "window"]
    day = sessions.select("ny_date", F.unix_micros("open").alias("o_us"), F.unix_micros("close").alias("c_us"))
    day = day.withColumn("s_no", F.row_number().over(Window.orderBy("ny_date")))  # some 250 rows a year
    span = F.floor((F.col("last_due_us") - F.col("first_due_us")) / spec.step_us).cast("long") + 1
    w = windows.withColumn("n", span).withColumn("start", F.timestamp_micros("first_due_us"))
    w = w.withColumn("t_date", ny_date(F.col("start"))).withColumn("clock", F.from_utc_timestamp("start", NY) - F.to_date(F.from_utc_timestamp("start", NY)).cast("timestamp"))
    own = day.select(F.col("ny_date").alias("t_date"), F.col("s_no").alias("t_no"), F.col("o_us").alias("t_o"), F.col("c_us").alias("t_c"))
    w = w.join(own, "t_date", "left")
    even = (F.col("n") == F.col("n_due")) & F.col("t_no").isNotNull()
    pre, reg = label_counts(F.col("first_due_us"), F.col("n"), F.col("t_o"), F.col("t_c"), spec.step_us)
    asked = w.where(even).select(*key, "n", "clock", "t_no", pre.alias("t_pre"), reg.alias("t_reg"))
    asked = asked.withColumn("s_no", F.explode(F.sequence(F.col("t_no") - spec.baseline_lookback, F.col("t_no") - 1)))
    cand = asked.join(day, "s_no")
    start = F.to_utc_timestamp(F.col("ny_date").cast("timestamp") + F.col("clock"), NY)
    cand = cand.withColumn("c_start", start).withColumn("c_start_us", F.unix_micros("c_start"))
    pre, reg = label_counts(F.col("c_start_us"), F.col("n"), F.col("o_us"), F.col("c_us"), spec.step_us)
    cand = cand.where((pre == F.col("t_pre")) & (reg == F.col("t_reg"))).withColumn("c_end", F.timestamp_micros(F.col("c_start_us") + F.col("n") * long(spec.step_us)))
    cand = cand.select(*key, "s_no", "n", "c_start_us", (F.col("c_start_us") + F.col("n") * long(spec.step_us)).alias("c_end_us"))
    spoilt = met(cand.select(*key, "s_no", "c_start_us", "c_end_us"), registry, F.col("symbol"), F.col("c_start_us"), F.col("c_end_us"), provider, feed, "left_semi").select(*key, "s_no").distinct()
    cand = cand.join(spoilt, [*key, "s_no"], "left_anti")
    sums = range_sums(cand, bars, [*key, "s_no", "n"], "c_start_us", "c_end_us", spec.step_us).where("m = n")
    latest = sums.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("s_no")))).where(F.col("k") <= spec.baseline_sessions)
    base = latest.groupBy(*key).agg(F.count("*").alias("volume_rel_n_windows"), F.avg("v").alias("base"))
    out = w.join(base, key, "left")
    n = F.coalesce("volume_rel_n_windows", F.lit(0))
    status = coalesced_status(
        (F.col("n") != F.col("n_due"), "not_comparable_excluded_minutes"),
        (F.col("t_no").isNull(), "target_session_closed"),
        (n < spec.baseline_min, "insufficient_comparable_history"),
        (F.col("base") <= 0, "zero_baseline"),
        otherwise="ok",
    )
    return out.select(*key, F.when(status == "ok", ratio(F.col("volume"), F.col("base"))).alias("volume_rel"), status.alias("volume_rel_status"), n.alias("volume_rel_n_windows"))
