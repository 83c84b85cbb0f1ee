"""Bars: building them, integrity, provenance, and coverage of sessions slot by slot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import present, ratio
from ..functions.times import MINUTE_US, long
from ..sources.registry import NOT_EXPECTED, day_index, day_of

PRICES = ("open", "high", "low", "close")
#: Defects of `integrity` that make rows unusable.
DEFECTS = ("duplicate_timestamp_count", "misaligned_timestamp_count", "null_or_nonfinite_count", "invalid_ohlc_count", "non_positive_price_count", "negative_volume_count")
PROVENANCE = ("source", "feed", "feed_scope", "adjustment", "timeframe")


def from_ticks(ticks: DataFrame, symbol: str, us: str, tiebreak: str, price: str, step_us: int) -> DataFrame:
    """Bars of step_us: symbol, bar_us, open, high, low, close, volume (number of ticks). One aggregation, combined before its shuffle."""
    start = F.col(us) - F.pmod(F.col(us), F.lit(step_us))
    order = F.struct(us, tiebreak)
    p = present(F.col(price))
    return ticks.groupBy(F.col(symbol).alias("symbol"), start.alias("bar_us")).agg(
        F.min_by(p, order).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, order).alias("close"), F.count("*").cast("double").alias("volume")
    )


def finite() -> Column:
    ok = F.lit(True)
    for c in (*PRICES, "volume"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return ok


def bad_ohlc() -> Column:
    o, h, low, c = (F.col(x) for x in PRICES)
    return (h < low) | (h < o) | (h < c) | (low > o) | (low > c)


def off_grid(us: Column, minutes: int = 1) -> Column:
    """Not on a whole minute, or off the clock grid of a sub-hour step that divides the hour."""
    bad = F.pmod(us, F.lit(MINUTE_US)) != 0
    return bad | (F.pmod(us, F.lit(minutes * MINUTE_US)) != 0) if minutes < 60 and 60 % minutes == 0 else bad


def is_naive(bars: DataFrame, ts: str) -> bool:
    return dict(bars.dtypes)[ts] == "timestamp_ntz"


def integrity(bars: DataFrame, by: Sequence[str], us: str = "bar_us", minutes: int = 1, volume_factor: float | None = 10.0) -> DataFrame:
    """Counts of defects for each group; value checks run on rows with finite values only.

    Duplicates and repeats are counted by (group, start); the volume outliers need the group's exact median of positive volumes first (none are looked for if volume_factor is None).
    """
    ok = finite()
    rows = bars.withColumn("__median", F.lit(None).cast("double"))
    if volume_factor is not None:
        rows = bars.join(bars.where(ok & (F.col("volume") > 0)).groupBy(*by).agg(F.median("volume").alias("__median")), list(by), "left")
    rows = rows.withColumn("__ok", ok)
    per_start = rows.groupBy(*by, us).agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("__ok")).alias("nonfinite"),
        F.count_if(F.col("__ok") & bad_ohlc()).alias("ohlc"),
        F.count_if(F.col("__ok") & ((F.col("open") <= 0) | (F.col("high") <= 0) | (F.col("low") <= 0) | (F.col("close") <= 0))).alias("nonpositive"),
        F.count_if(F.col("__ok") & (F.col("volume") < 0)).alias("negative"),
        F.count_if(F.col("__ok") & (F.col("volume") > F.col("__median") * (volume_factor or 0.0))).alias("suspicious"),
    )
    total = lambda c, name: F.sum(c).alias(name)
    return per_start.groupBy(*by).agg(
        total("n", "total_rows"), F.sum(F.col("n") - 1).alias("duplicate_timestamp_count"), F.sum(F.when(off_grid(F.col(us), minutes), F.col("n")).otherwise(0)).alias("misaligned_timestamp_count"),
        total("nonfinite", "null_or_nonfinite_count"), total("ohlc", "invalid_ohlc_count"), total("nonpositive", "non_positive_price_count"), total("negative", "negative_volume_count"), total("suspicious", "suspicious_volume_count"),
    )


def provenance_faults(bars: DataFrame, expected: dict[str, str]) -> DataFrame:
    """One row: for each provenance column how many rows are null or differ from the expected value. All rows are looked at."""
    have = set(bars.columns)
    agg = []
    for c, value in expected.items():
        wrong = F.count_if(F.col(c).isNull() | (F.col(c) != value)) if c in have else F.count("*")
        agg.append(wrong.alias(f"{c}_faults"))
    return bars.agg(F.count("*").alias("rows"), *agg)


def require_provenance(bars: DataFrame, expected: dict[str, str], unlabelled_source: str | None = None) -> None:
    """Raises if any row is of another dataset. Tables without any provenance column pass only for the source that predates them."""
    if unlabelled_source and expected.get("source") == unlabelled_source and not any(c in bars.columns for c in ("feed", "feed_scope")):
        expected = {k: v for k, v in expected.items() if k in bars.columns}
    row = provenance_faults(bars, expected).first().asDict()
    wrong = {k: v for k, v in row.items() if k != "rows" and v}
    if wrong:
        raise ValueError(f"rows of another dataset: {wrong}")


def _days(sessions: DataFrame, end: str = "close_us") -> DataFrame:
    """Sessions (session, open_us, close_us) with a row for each UTC day that they touch, two at most: `__day`."""
    return sessions.where(F.col(end) > F.col("open_us")).withColumn("__day", F.explode(F.sequence(day_of(F.col("open_us")), day_of(F.col(end) - 1))))


def _slot(at: Column, step_us: int) -> Column:
    """The first slot that starts at or after an instant."""
    return F.ceil((at - F.col("open_us")) / step_us)


def _slot_marks(sessions: DataFrame, registry: DataFrame, step_us: int, provider: str, feed: str) -> DataFrame:
    """(x_scope, session, slot, off, known): slots that start inside an interval without expected bars, or inside a known gap. Entries meet sessions by equality of days."""
    x = day_index(registry, provider, feed).where(F.col("x_classification").isin(*NOT_EXPECTED) | ((F.col("x_classification") == "provider_gap") & ~F.col("x_retry_appropriate")))
    both = _days(sessions.select("session", "open_us", "close_us").distinct()).join(x, (F.col("__day") == F.col("x_day")) & (F.col("open_us") < F.col("x_to")) & (F.col("x_from") < F.col("close_us")))
    both = both.where(F.col("__day") == F.greatest(day_of(F.col("open_us")), day_of(F.col("x_from"))))  # each pair once, on the first day that both touch
    lo, hi = F.greatest(F.lit(0), _slot(F.col("x_from"), step_us)), F.least(_slot(F.col("close_us"), step_us), _slot(F.col("x_to"), step_us))
    both = both.select("x_scope", "session", lo.alias("lo"), hi.alias("hi"), F.col("x_classification").isin(*NOT_EXPECTED).alias("off")).where("lo < hi")
    return both.select("x_scope", "session", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("slot"), "off", (~F.col("off")).alias("known"))


def _judged(grid: DataFrame, limits: DataFrame, on: Sequence[str], bars: DataFrame, sessions: DataFrame, by: Sequence[str], step_us: int, min_ratio: float, registry: DataFrame | None, provider: str, feed: str) -> DataFrame:
    """grid with a verdict on each row. limits: what bounds the due slots (`on`, n_slots, end_us and the grid's other columns); by and session pick a grid row's bars.

    Only slots with a bar or a mark have rows, and counts say the rest: what is neither covered, excluded nor known is unexplained.
    """
    inside = (F.col("bar_us") >= F.col("open_us")) & (F.col("bar_us") < F.col("close_us"))
    spans = _days(sessions.select("session", "open_us", "close_us").distinct())
    hits = bars.select(*by, "bar_us").withColumn("__day", day_of(F.col("bar_us"))).join(spans, "__day").where(inside)
    facts = hits.groupBy(*by, "session", F.floor((F.col("bar_us") - F.col("open_us")) / step_us).alias("slot")).agg(F.min("bar_us").alias("at"))
    off = known = F.lit(False)
    if registry is not None:
        marks = _slot_marks(sessions, registry, step_us, provider, feed)
        who = grid.select(*by, "session").distinct().withColumn("x_scope", F.explode(F.array("symbol", F.lit("*"))))
        marks = who.join(marks, ["x_scope", "session"]).select(*by, "session", "slot", F.lit(None).cast("long").alias("at"), "off", "known")
        facts = facts.withColumns({"off": F.lit(False), "known": F.lit(False)}).unionByName(marks).groupBy(*by, "session", "slot").agg(F.min("at").alias("at"), F.bool_or("off").alias("off"), F.bool_or("known").alias("known"))
        off, known = F.col("off"), F.col("known")
    rows = facts.join(limits, list(on)).where(F.col("slot") < F.col("n_slots"))
    hit = F.coalesce(F.col("at") < F.col("end_us"), F.lit(False))
    said = hit | off | known
    key = [*by, "session", *(c for c in limits.columns if c not in (*by, "session", "end_us", "in_progress", "n_slots"))]
    counts = rows.groupBy(*key).agg(
        F.count_if(off).alias("excluded"), F.count_if(hit & ~off).alias("covered"), F.count_if(~hit & ~off & known).alias("known_missing"), F.bool_or(said & (F.col("slot") == 0)).alias("opened"), F.bool_or(said & (F.col("slot") == F.col("n_slots") - 1)).alias("closed")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    out = grid.join(counts, key, "left").withColumns({c: zero(c) for c in ("excluded", "covered", "known_missing")})
    tradable = F.col("n_slots") - F.col("excluded")
    judged = tradable - F.col("known_missing")
    out = out.withColumns({"unexplained": judged - F.col("covered"), "tradable": tradable, "judged": judged, "completeness": F.when(judged > 0, ratio(F.col("covered"), judged)).otherwise(F.lit(1.0))})
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False)) & ~F.col("in_progress")
    verdict = (
        F.when(F.col("in_progress"), "provisional").when(F.col("tradable") == 0, "nothing_due").when((F.col("covered") == 0) & (F.col("unexplained") == F.col("tradable")), "missing").when(F.col("completeness") < min_ratio, "incomplete").otherwise("complete")
    )
    edges = {"missing_open_edge": no("opened") & (F.col("n_slots") > 0), "missing_close_edge": no("closed") & (F.col("n_slots") > 1)}
    return out.withColumns({"verdict": verdict, **edges}).drop("opened", "closed", "end_us")


def _due(sessions: DataFrame, as_of_us: Column | None, step_us: int) -> DataFrame:
    """Sessions begun by the instant, with end_us, in_progress and n_slots: what of them is due."""
    s = sessions if as_of_us is None else sessions.where(F.col("open_us") <= as_of_us)
    s = s.withColumn("end_us", F.col("close_us") if as_of_us is None else F.least("close_us", as_of_us)).withColumn("in_progress", F.lit(False) if as_of_us is None else F.col("close_us") > as_of_us)
    return s.withColumn("n_slots", F.greatest(F.lit(0), F.ceil((F.col("end_us") - F.col("open_us")) / step_us)).cast("long"))


def slot_coverage(
    bars: DataFrame, sessions: DataFrame, by: Sequence[str], step_us: int, as_of_us: int | None = None, min_ratio: float = 0.98, registry: DataFrame | None = None, provider: str = "alpaca", feed: str = "sip", groups: DataFrame | None = None
) -> DataFrame:
    """A row for each group (those of the bars, unless `groups` names them) and started session, judged slot by slot.

    sessions: session, open_us, close_us. Slot i is [open + i * step, open + (i + 1) * step); the elapsed ones up to as_of are due. Slots that start
    inside an interval without expected bars are excluded, missing ones inside a known gap are known. verdict: provisional, nothing_due, missing,
    incomplete (covered / judged below min_ratio), complete. Sessions don't overlap, and each lies within 24 hours of its opening. So a bar meets its
    session by an equi-join on the UTC days that the session touches, two at most, and then its slot by number.
    """
    s = _due(sessions.select("session", "open_us", "close_us"), None if as_of_us is None else long(as_of_us), step_us)
    limits = s.select("session", "n_slots", "end_us", "in_progress")
    # the result has a row for each group and session: the product is the report itself
    grid = (bars.select(*by).distinct() if groups is None else groups.select(*by)).crossJoin(limits)
    return _judged(grid, limits, ["session"], bars, s, by, step_us, min_ratio, registry, provider, feed)


def claimed_sessions(claims: DataFrame, sessions: DataFrame, bars: DataFrame, by: Sequence[str], step_us: int, min_ratio: float = 0.98, registry: DataFrame | None = None, provider: str = "alpaca", feed: str = "sip") -> DataFrame:
    """slot_coverage for claims, each as of an instant of its own: a row for each claim and session of its days begun by then.

    claims: by, claim, start, end (days), as_of_us. sessions: session (the day), open_us, close_us. Claims meet sessions by their days, and the bars' slots are found once for all claims.
    """
    due = claims.select(*by, "claim", "as_of_us", F.explode(F.sequence("start", "end")).alias("session")).join(sessions.select("session", "open_us", "close_us"), "session")
    grid = _due(due, F.col("as_of_us"), step_us)
    limits = grid.select(*by, "session", "claim", "n_slots", "end_us", "in_progress")
    return _judged(limits, limits, [*by, "session"], bars, grid, by, step_us, min_ratio, registry, provider, feed)


def gaps(bars: DataFrame, by: Sequence[str], threshold_us: int, us: str = "bar_us") -> DataFrame:
    """Steps between consecutive bars of a group above the threshold: start, end, gap_us."""
    before = F.lag(us).over(Window.partitionBy(*by).orderBy(us))
    return bars.withColumn("gap_start_us", before).withColumn("gap_us", F.col(us) - before).where(F.col("gap_us") > threshold_us).select(*by, "gap_start_us", F.col(us).alias("gap_end_us"), "gap_us")


def missing_offsets(releases: DataFrame, bars: DataFrame, keys: Sequence[str], offsets: Sequence[int], step_us: int, unit_us: int | None = None) -> DataFrame:
    """For each release (keys, symbol, t_us) the required offsets without a bar starting in [t + offset, + step), sorted; empty if all are there.

    An interval of one step holds a grid point at most, so each offset is an equi-join on the first grid point at or after its start.
    """
    unit = unit_us or step_us
    probe = releases.select(*keys, "symbol", "t_us", F.explode(F.array(*map(F.lit, offsets))).alias("offset")).withColumn("from_us", F.col("t_us") + F.col("offset") * long(unit))
    probe = probe.withColumn("at", F.col("from_us") + F.pmod(-F.col("from_us"), F.lit(step_us)))
    b = bars.select(F.col("symbol").alias("b_symbol"), F.col("bar_us").alias("b_us")).distinct()
    rows = probe.join(b, (F.col("symbol") == F.col("b_symbol")) & (F.col("at") == F.col("b_us")), "left")
    return rows.groupBy(*keys, "symbol").agg(F.array_sort(F.collect_list(F.when(F.col("b_us").isNull(), F.col("offset")))).alias("missing"))


def out_of_order(bars: DataFrame, by: Sequence[str], pos: str, us: str = "bar_us") -> DataFrame:
    """by, unsorted_rows: rows that start before the row just before them in the file (pos)."""
    before = F.lag(us).over(Window.partitionBy(*by).orderBy(pos))
    return bars.withColumn("__late", F.col(us) < before).groupBy(*by).agg(F.count_if("__late").alias("unsorted_rows"))


def session_gaps(bars: DataFrame, sessions: DataFrame, by: Sequence[str], threshold_us: int) -> DataFrame:
    """by, gaps_in_sessions, longest_gap_us: steps above the threshold between bars of one session."""
    inside = bars.withColumn("__day", day_of(F.col("bar_us"))).join(_days(sessions.select("session", "open_us", "close_us")), "__day").where((F.col("bar_us") >= F.col("open_us")) & (F.col("bar_us") < F.col("close_us")))
    found = gaps(inside.select(*by, "session", "bar_us"), [*by, "session"], threshold_us)
    return found.groupBy(*by).agg(F.count("*").alias("gaps_in_sessions"), F.max("gap_us").alias("longest_gap_us"))


def validation_report(integrity_rows: DataFrame, session_rows: DataFrame, by: Sequence[str], sparse: bool = False) -> DataFrame:
    """One row for each dataset: defect counts, session counts and dates, minutes, coverage ratio, is_clean, is_hard_failure.

    A hard failure is a structural defect, a session without bars or, unless the feed is sparse (a single venue), an incomplete session or a missing edge. integrity_rows may
    have unsorted_rows and naive_timestamp_count too. A known gap is never clean; a session in progress is no failure.
    """
    v = F.col("verdict")
    dates = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("session"))))  # noqa: E731  sessions of a year or of a symbol
    s = session_rows.groupBy(*by).agg(
        F.count("*").alias("expected_trading_sessions"), F.count_if(F.col("covered") > 0).alias("sessions_present"), F.count_if(v == "complete").alias("sessions_complete"), F.count_if(v == "missing").alias("sessions_missing"),
        F.count_if(v == "incomplete").alias("sessions_incomplete"), F.count_if(v == "provisional").alias("sessions_provisional"), F.count_if(v == "nothing_due").alias("sessions_nothing_due"), F.sum("tradable").alias("expected_regular_minutes"),
        F.sum("excluded").alias("excluded_regular_minutes"), F.sum("known_missing").alias("known_gap_minutes"), F.sum("unexplained").alias("unexplained_missing_minutes"), F.sum("covered").alias("covered_minutes"),
        F.count_if("missing_open_edge").alias("open_edges"), F.count_if("missing_close_edge").alias("close_edges"), F.min("completeness").alias("least_completeness"), dates(v == "missing").alias("missing_sessions"),
        dates(v == "incomplete").alias("incomplete_sessions"), dates(F.col("missing_open_edge")).alias("sessions_missing_open_edge"), dates(F.col("missing_close_edge")).alias("sessions_missing_close_edge"), F.min("session").alias("first_session"),
        F.max("session").alias("last_session"), dates(F.col("known_missing") > 0).alias("known_gap_sessions"), dates(v == "provisional").alias("provisional_sessions"),
    )
    out = integrity_rows.join(s, list(by), "left")
    counts = [*DEFECTS, "unsorted_rows", "naive_timestamp_count"]
    structural = sum((F.coalesce(F.col(c), F.lit(0)) for c in counts if c in out.columns), F.lit(0))
    n = lambda *names: sum((F.coalesce(F.col(c), F.lit(0)) for c in names), F.lit(0))
    soft = n("sessions_incomplete", "open_edges", "close_edges")
    first = lambda c: F.date_format(F.element_at(c, 1), "yyyy-MM-dd")
    lists = (("sessions_missing", "sessions have no rows", "missing_sessions"), ("sessions_incomplete", "sessions are incomplete", "incomplete_sessions"), ("open_edges", "sessions lack their opening minute", "sessions_missing_open_edge"), ("close_edges", "sessions lack their closing minute", "sessions_missing_close_edge"))
    said = [F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.concat(F.col(c).cast("string"), F.lit(" rows: " + c.removesuffix("_count").replace("_", " ")))) for c in counts if c in out.columns]
    said += [F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {text} (first: "), first(days), F.lit(")"))) for c, text, days in lists]
    said += [F.when(F.coalesce("known_gap_minutes", F.lit(0)) > 0, F.concat(F.col("known_gap_minutes").cast("string"), F.lit(" missing minutes are registered gaps (first: "), first("known_gap_sessions"), F.lit(")")))]
    return out.withColumns({
        "issues": F.array_join(F.array_compact(F.array(*said)), "; "), "coverage_ratio": ratio(F.col("covered_minutes"), F.col("expected_regular_minutes")), "bar_density": F.lit("sparse" if sparse else "dense"),
        "is_hard_failure": (structural > 0) | (n("sessions_missing") > 0) | (F.lit(False) if sparse else soft > 0),
        "is_clean": (structural == 0) & (n("sessions_missing", "known_gap_minutes") + soft == 0),
    })
