"""Reconciling calendars with official statistics, without look-ahead.

Calendar rows of two sources are matched into releases (connected components of a compatibility relation), official vintages
are looked up forward from the release date within a lag, and prior periods are checked against the vintages of the releases
before. Every missing comparison has a status.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import coalesced_status, compare_displayed, decimals, half_up, official_status
from ..functions.times import NY, prior_month
from ..store import smallest_reached


#: Vintages that `release_vintage` gives to one task, about.
TASK_ROWS = 500_000


def release_vintage(rows: DataFrame, vintages: DataFrame, keys: Sequence[str], release: str, vintage: str, value: str, max_lag_days: int = 3) -> DataFrame:
    """rows with the as-of value that was public at, or right after, the release: vintage_code, vintage_value, vintage_date.

    Of the vintages dated release .. release + lag the earliest counts: OK, or AMBIGUOUS if it has different values. Without one: NONE (no vintage at all, or no
    release date), LOOKAHEAD_REJECTED if some are later than the lag, else PREDATES_RELEASE. rows are told apart by all their columns.
    """
    v = vintages.where(F.col(value).isNotNull() & F.col(vintage).isNotNull()).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(vintage).alias("__v"), F.col(value).alias("__x"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    # what a task sorts stays as it is when there are more vintages: their number, not the session's, decides the number of tasks
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-v.count() // TASK_ROWS))
    v = v.repartition(parts, *[f"__{k}" for k in keys])
    j = rows.withColumn("__id", F.xxhash64(*rows.columns)).repartition(parts, *keys).join(v, on, "left")
    day, latest = F.col(release), F.date_add(F.col(release), max_lag_days)
    eligible = F.col("__v").between(day, latest)
    first = F.min(F.when(eligible, F.col("__v"))).over(Window.partitionBy("__id", *rows.columns))
    at_first = F.col("__v") == F.col("__first")
    j = j.withColumn("__first", first)
    out = j.groupBy("__id", *rows.columns).agg(
        F.count("__v").alias("n"), F.count_distinct(F.when(at_first, F.col("__x"))).alias("n_values"), F.max(F.when(at_first, F.col("__x"))).alias("x"), F.max("__first").alias("d"),
        F.bool_or(F.col("__v") > latest).alias("late"),
    )
    code = coalesced_status(
        ((F.col("n") == 0) | F.col(release).isNull(), "NONE"), (F.col("n_values") > 1, "AMBIGUOUS"), (F.col("n_values") == 1, "OK"), (F.col("late"), "LOOKAHEAD_REJECTED"), otherwise="PREDATES_RELEASE"
    )
    ok = code == "OK"
    return out.select(*rows.columns, code.alias("vintage_code"), F.when(ok, F.col("x")).alias("vintage_value"), F.when(ok, F.col("d")).alias("vintage_date"))


def compatible(a: str, b: str, days: int = 1) -> Column:
    """Two calendar rows (columns a_... and b_...) may be the same release: equal periods if both have one, else dates within a day or so."""
    both = F.col(f"{a}_period").isNotNull() & F.col(f"{b}_period").isNotNull()
    near = F.abs(F.datediff(F.col(f"{a}_date"), F.col(f"{b}_date"))) <= days
    return F.when(both, F.col(f"{a}_period") == F.col(f"{b}_period")).otherwise(F.coalesce(near, F.lit(False)))


def compatibility_edges(rows: DataFrame, days: int = 1) -> DataFrame:
    """(a, b) with a < b: pairs of row_ids of a family that are compatible and connect all that are. Equi-joins only: on the period, and on the date shifted by each allowed difference.

    rows: row_id (long), event_family, period, date. Rows of one period are linked to its smallest row, which is compatible with all of them, so a period's rows give a star and not all pairs.
    Rows of one date without a period are compatible too: the smallest of them stands for the others, and every row near in time meets only it.
    """
    star = rows.where("period is not null").groupBy("event_family", "period").agg(F.min("row_id").alias("a"))
    by_period = rows.join(star, ["event_family", "period"]).select("a", F.col("row_id").alias("b"))
    lone = rows.where("period is null and date is not null").groupBy("event_family", "date").agg(F.min("row_id").alias("a"))
    near = rows.where("date is not null").withColumn("k", F.explode(F.sequence(F.lit(-days), F.lit(days)))).select("event_family", F.date_add("date", F.col("k")).alias("date"), F.col("row_id").alias("b"))
    by_date = near.join(lone, ["event_family", "date"]).select("a", "b")
    both = by_period.unionByName(by_date).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return both.where("a < b").distinct()


def matched_releases(rows: DataFrame, days: int = 1) -> DataFrame:
    """rows (row_id, event_family, period, date, ...) with release_no: the smallest row_id of its component of compatible rows."""
    reached = smallest_reached(compatibility_edges(rows.select("row_id", "event_family", "period", "date"), days))
    return rows.join(reached.withColumnRenamed("node", "row_id"), "row_id", "left").withColumn("release_no", F.coalesce("root", "row_id")).drop("root")


def prior_release_dates(releases: DataFrame) -> DataFrame:
    """releases (event_family, release_bundle, period, release_date, source_rank) with the release date of the period before: the family's own, else a bundle sibling's; the better source wins."""
    by = lambda keys: releases.where("release_date is not null and period is not null").groupBy(*keys, "period").agg(F.min_by("release_date", F.struct("source_rank", "release_date")).alias("d"))
    own = by(["event_family"]).select(F.col("event_family").alias("__f"), F.col("period").alias("__p"), F.col("d").alias("own_date"))
    sibling = by(["release_bundle"]).select(F.col("release_bundle").alias("__b"), F.col("period").alias("__q"), F.col("d").alias("bundle_date"))
    r = releases.withColumn("previous_period", prior_month(F.col("period")))
    r = r.join(own, (F.col("event_family") == F.col("__f")) & (F.col("previous_period") == F.col("__p")), "left").drop("__f", "__p")
    r = r.join(sibling, (F.col("release_bundle") == F.col("__b")) & (F.col("previous_period") == F.col("__q")), "left").drop("__b", "__q")
    return r.withColumn("previous_release_date", F.coalesce("own_date", "bundle_date")).drop("own_date", "bundle_date")


def prior_validation(rows: DataFrame, vintages: DataFrame, max_lag_days: int = 3) -> DataFrame:
    """previous_* against the vintage of the prior period's own release, revised_previous_* against the vintage at this release.

    rows: event_family, period, previous_period, release_date, previous_release_date, previous, revised_previous, ...; vintages: event_family, period, vintage_date, value.
    """
    v = vintages.select("event_family", F.col("period").alias("previous_period"), F.col("vintage_date").alias("vd"), F.col("value").alias("vv"))
    out = release_vintage(rows, v, ["event_family", "previous_period"], "previous_release_date", "vd", "vv", max_lag_days)
    out = out.withColumnsRenamed({"vintage_code": "previous_vintage_code", "vintage_value": "previous_official", "vintage_date": "previous_official_date"})
    out = release_vintage(out, v, ["event_family", "previous_period"], "release_date", "vd", "vv", max_lag_days)
    out = out.withColumnsRenamed({"vintage_code": "revised_vintage_code", "vintage_value": "revised_official", "vintage_date": "revised_official_date"})
    status = lambda shown, official, code: F.when(F.col(shown).isNull(), "no_calendar_value").when(F.col(official).isNull(), F.lower(F.col(code))).otherwise(F.lower(compare_displayed(F.col(shown), F.col(official))))
    return out.withColumns({
        "previous_validation_status": status("previous", "previous_official", "previous_vintage_code"),
        "revised_previous_validation_status": status("revised_previous", "revised_official", "revised_vintage_code"),
        "official_prior_period_revision": F.col("revised_official") - F.col("previous_official"),
    })


def reconciled(rows: DataFrame, display_decimals: dict[str, int] | None = None, tolerance_s: float = 60.0) -> DataFrame:
    """One status per release, by fixed priority, with all that was found as issues.

    rows: a_actual, b_actual (calendars), a_unit, b_unit, a_ts, b_ts (instants), official_value, official_unit, vintage_code, semantic_issue.
    Priority: SEMANTIC_MISMATCH, UNIT_MISMATCH, VALUE_CONFLICT (the calendars disagree), TIMESTAMP_CONFLICT, VINTAGE_AMBIGUOUS, LOOKAHEAD_REJECTED, OFFICIAL_MISMATCH, MISSING_SOURCE, NO_OFFICIAL_VINTAGE, MATCH.
    """
    shown = display_decimals or {"PERCENT": 1, "THOUSANDS": 0}
    both = F.col("a_actual").isNotNull() & F.col("b_actual").isNotNull()
    units = F.col("a_unit").isNotNull() & F.col("b_unit").isNotNull() & (F.col("a_unit") != "UNKNOWN") & (F.col("b_unit") != "UNKNOWN")
    least = F.lit(0)
    for unit, n in shown.items():
        least = F.when(F.col("official_unit") == unit, n).otherwise(least)
    # what others ask for several times is a column, which is made once for a row; within expressions it would be made as often as it is asked for
    unit = F.when(F.col("a_actual").isNotNull(), F.col("a_unit")).otherwise(F.col("b_unit"))
    rows = rows.withColumns({"actual_value": F.coalesce("a_actual", "b_actual"), "__least": least, "__unit": unit})
    actual, official = F.col("actual_value"), F.col("official_value")
    rows = rows.withColumn("comparison_decimals", F.greatest("__least", decimals(actual)))
    comparable = (F.col("__unit") == F.col("official_unit")) & (F.col("__unit") != "UNKNOWN")
    rounded = half_up(official, F.col("comparison_decimals"))
    made = (
        F.when(official.isNull(), "NO_OFFICIAL_VINTAGE").when(actual.isNull(), "NO_ACTUAL").when(~F.coalesce(comparable, F.lit(False)), "UNIT_UNKNOWN")
        .when(F.abs(actual - official) <= 1e-9, "EXACT_MATCH").when(F.abs(actual - rounded) <= 1e-9, "ROUNDING_MATCH").otherwise("VALUE_MISMATCH")
    )
    rows = rows.withColumn("release_actual_match_status", made).drop("__least", "__unit")
    outcome = F.col("release_actual_match_status")
    gap_s = F.abs(F.unix_micros("a_ts") - F.unix_micros("b_ts")) / 1e6
    flags = {
        "SEMANTIC_MISMATCH": F.col("semantic_issue").isNotNull(),
        "UNIT_MISMATCH": units & (F.col("a_unit") != F.col("b_unit")),
        "VALUE_CONFLICT": both & units & (F.abs(F.col("a_actual") - F.col("b_actual")) > 1e-9),
        "TIMESTAMP_CONFLICT": gap_s > tolerance_s,
        "VINTAGE_AMBIGUOUS": F.col("vintage_code") == "AMBIGUOUS",
        "LOOKAHEAD_REJECTED": F.col("vintage_code") == "LOOKAHEAD_REJECTED",
        "OFFICIAL_MISMATCH": outcome == "VALUE_MISMATCH",
        "MISSING_SOURCE": F.col("a_actual").isNull() | F.col("b_actual").isNull(),
        "NO_OFFICIAL_VINTAGE": outcome == "NO_OFFICIAL_VINTAGE",
    }
    held = {k: F.coalesce(c, F.lit(False)) for k, c in flags.items()}
    issues = F.array_join(F.filter(F.array(*[F.when(c, k) for k, c in held.items()]), lambda x: x.isNotNull()), " | ")
    return rows.withColumns({
        "actual_minus_official": actual - official, "timestamp_delta_seconds": gap_s,
        "source_match_status": coalesced_status(*[(c, k) for k, c in held.items()], otherwise="MATCH"), "issues": issues,
    })


def broker_timezone_verdict(rows: DataFrame, min_releases: int = 2) -> DataFrame:
    """Does a candidate zone turn server-local times into the confirmed release times? One row.

    rows: trusted_us (confirmed instant), converted_us (server time by the candidate zone), offset_hours (implied). A release whose rows all match is a MATCH. Enough evidence is at least
    min_releases releases and, if the zone changes its offset in the years seen, two observed offsets (column zone_changes).
    """
    per = rows.where("trusted_us is not null").groupBy("trusted_us").agg(
        F.bool_and(F.abs(F.col("converted_us") - F.col("trusted_us")) <= 60_000_000).alias("match"), F.count("converted_us").alias("n"), F.max("offset_hours").alias("offset_hours"), F.bool_or("zone_changes").alias("zone_changes")
    )
    out = per.where("n > 0").agg(F.count("*").alias("releases"), F.count_if("match").alias("matching"), F.count_distinct("offset_hours").alias("offsets"), F.bool_or("zone_changes").alias("zone_changes"))
    enough = (F.col("releases") >= min_releases) & (~F.coalesce("zone_changes", F.lit(False)) | (F.col("offsets") >= 2))
    return out.withColumn("verdict", F.when(F.col("releases") == 0, "UNVERIFIABLE").when(F.col("matching") < F.col("releases"), "MISMATCH").when(enough, "MATCH").otherwise("UNVERIFIABLE"))


def macro_comparison(events: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Cross-source comparison: event_family, reference_key, field, status, values, units, note.

    Fields: actual (sources among themselves), actual_vs_official_asof:<date> for each vintage date, actual_vs_official_latest_revised, and actual_vs_official_asof when only a
    revised value exists. The last value (by position) of a source counts. Values of unknown unit are never compared.
    events: event_family, source, reference_period, release_timestamp_utc, actual, actual_unit, official_actual, official_actual_unit, official_vintage_kind, official_vintage_date, position.
    """
    key = F.coalesce(F.concat(F.lit("period:"), F.col("reference_period").cast("string")), F.concat(F.lit("release:"), F.to_date("release_timestamp_utc").cast("string")))
    e = events.withColumn("reference_key", key).where("reference_key is not null")
    group = ["event_family", "reference_key"]
    actual = e.where("actual is not null").select(*group, F.lit("actual").alias("field"), F.col("source").alias("who"), F.col("actual").alias("x"), F.coalesce("actual_unit", F.lit("UNKNOWN")).alias("u"), "position")
    asof = F.col("official_vintage_kind") == "AS_OF"
    field = F.when(asof, F.concat(F.lit("actual_vs_official_asof:"), F.coalesce(F.col("official_vintage_date").cast("string"), F.lit("unknown")))).otherwise("actual_vs_official_latest_revised")
    official = e.where("official_actual is not null").select(
        *group, field.alias("field"), F.concat_ws(":", "source", F.lit("official"), F.coalesce("official_vintage_kind", F.lit("None"))).alias("who"), F.col("official_actual").alias("x"), F.coalesce("official_actual_unit", F.lit("UNKNOWN")).alias("u"), "position",
    )
    fields = official.select(*group, "field").distinct()
    shared = actual.drop("field").join(fields, group)
    has_asof = fields.where(F.col("field").startswith("actual_vs_official_asof")).select(*group).distinct()
    revised = fields.where("field = 'actual_vs_official_latest_revised'").join(has_asof, group, "left_anti").select(*group)
    lacking = actual.join(revised, group, "left_semi").withColumn("field", F.lit("actual_vs_official_asof"))
    empty = e.select(*group).distinct().select(*group, F.lit("actual").alias("field"))
    cells = actual.unionByName(official).unionByName(shared.select(*actual.columns)).unionByName(lacking)
    last = cells.groupBy(*group, "field", "who").agg(F.max_by(F.struct("x", "u"), "position").alias("c")).select(*group, "field", "who", "c.*")
    known = F.col("u") != "UNKNOWN"
    x = F.when(known, F.col("x"))
    pair = F.struct("who", "x")
    out = last.groupBy(*group, "field").agg(
        F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("values"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("who", "u")))).alias("units"), F.count("*").alias("n"), F.count(x).alias("k"),
        F.count_distinct(F.when(known, F.col("u"))).alias("n_units"), (F.max(x) - F.min(x)).alias("spread"),
    )
    out = empty.join(out, [*group, "field"], "full_outer")
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    unavailable = F.col("field") == "actual_vs_official_asof"
    status = coalesced_status((unavailable | (k < 2) | (F.col("n_units") > 1), "MISSING"), (F.col("spread") == 0, "MATCH"), (F.col("spread") <= tolerance, "ROUNDING_DIFFERENCE"), otherwise="MISMATCH")
    note = F.when(unavailable, "no as-of vintage for this period").when((k < 2) & (n >= 2), "unit unknown or ambiguous").when(F.col("n_units") > 1, "differing units")
    return out.select(*group, "field", status.alias("status"), "values", "units", note.alias("note"))


def semantic_issue(events: DataFrame, families: DataFrame, series: DataFrame) -> DataFrame:
    """events (event_family, indicator, series_id) with semantic_issue: the label is another family's, or the official series has another adjustment, measure or scope than the family.

    families: event_family, label, adjustment, measure, scope. series: series_id, event_family, s_adjustment, s_measure, s_scope; both unique by their keys.
    """
    e = events.join(families, "event_family", "left").join(series, ["series_id", "event_family"], "left")
    faults = F.array(
        F.when(F.col("indicator") != F.col("label"), "label"),
        F.when(F.col("series_id").isNotNull() & F.col("s_adjustment").isNull(), "no_profile"),
        F.when(F.col("s_adjustment") != F.col("adjustment"), "adjustment"),
        F.when(F.col("s_measure") != F.col("measure"), "measure"),
        F.when(F.col("s_scope") != F.col("scope"), "scope"),
    )
    found = F.array_join(F.filter(faults, lambda x: x.isNotNull()), ",")
    return e.withColumn("semantic_issue", F.when(found != "", found)).drop("label", "adjustment", "measure", "scope", "s_adjustment", "s_measure", "s_scope")


#: Columns of a calendar row that the table hands on, if they are there.
CARRIED = (
    "event_id", "indicator", "source_event_id", "source_url", "source_timestamp", "source_timezone", "timestamp_quality", "importance", "provider_forecast", "actual_raw_text", "provider_forecast_raw_text", "previous_raw_text",
    "raw_artifact_checksum", "retrieval_timestamp_utc",
)


def _notes(ambiguous: Column, lag: Column, timezone_trusted: bool) -> Column:
    """What a reader of a row should know, in words; empty if there is nothing."""
    said = [
        (ambiguous, F.concat(F.lit("several rows of one calendar may be this release: "), F.col("n_a").cast("string"), F.lit(" of A, "), F.col("n_b").cast("string"), F.lit(" of B; none is compared"))),
        (F.col("period").isNull(), F.lit("no reference period is known, so there is no official vintage to compare with")),
        (F.col("a_ts").isNull() & F.col("b_ts").isNotNull() & F.lit(not timezone_trusted), F.lit("the only time is a server time of a zone that nobody has validated")),
        (F.col("timestamp_delta_seconds") > 60, F.concat(F.lit("the calendars' times differ by "), F.round("timestamp_delta_seconds").cast("long").cast("string"), F.lit(" s"))),
        (F.col("vintage_code") == "LOOKAHEAD_REJECTED", F.lit("official values exist only from later than the release may have seen")),
        (F.col("vintage_code") == "AMBIGUOUS", F.lit("the official source has several values of the release's first vintage")),
        (lag > 0, F.concat(F.lit("the official vintage is dated "), lag.cast("string"), F.lit(" days after the release"))),
        (F.col("semantic_issue").isNotNull(), F.concat(F.lit("the label or the official series means something else: "), F.col("semantic_issue"))),
    ]
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), text) for c, text in said])), "; ")


def release_table(calendars: DataFrame, official: DataFrame, start: str, end: str, max_lag_days: int = 3, timezone_trusted: bool = False, days: int = 1) -> DataFrame:
    """The reconciliation: a row for each release that the calendars A and B know in [start, end], in time order.

    calendars: row_id (long, unique), source (A has instants, B server times), event_family, release_bundle, reference_period, release_timestamp_utc, converted_utc (B's
    server time by the candidate zone), actual, actual_unit, previous, revised_previous, semantic_issue, and any of CARRIED, which each side's row hands on as a_ and b_ columns. official: event_family, period, vintage_date, value, unit; it enriches
    releases by (family, period) and never makes one. Components with two rows of a source are AMBIGUOUS_CANDIDATES and compared with nothing.
    trusted_release_timestamp_utc is A's instant, else B's converted one if the zone is trusted.
    """
    day = F.to_date(F.from_utc_timestamp(F.coalesce("release_timestamp_utc", "converted_utc"), NY))
    dated = calendars.withColumn("date", day)
    inside = dated.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    m = matched_releases(inside.withColumnRenamed("reference_period", "period"), days)
    is_a = F.col("source") == "A"
    fields = ("actual", "actual_unit", "release_timestamp_utc", "converted_utc", "previous", "revised_previous", *(c for c in CARRIED if c in calendars.columns))
    sides = [F.max_by(f, F.when(c, F.lit(1))).alias(f"{s}_{f}") for s, c in (("a", is_a), ("b", ~is_a)) for f in fields]
    r = m.groupBy("release_no", "event_family").agg(
        F.count_if(is_a).alias("n_a"), F.count_if(~is_a).alias("n_b"), F.max("period").alias("period"), F.min("date").alias("release_date"), F.max("release_bundle").alias("release_bundle"), F.max("semantic_issue").alias("semantic_issue"), *sides,
    )
    ambiguous = (F.col("n_a") > 1) | (F.col("n_b") > 1)
    r = r.withColumns({f"{s}_{f}": F.when(~ambiguous, F.col(f"{s}_{f}")) for s in "ab" for f in fields})
    r = r.withColumnsRenamed({"a_release_timestamp_utc": "a_ts", "b_converted_utc": "b_ts", "a_actual_unit": "a_unit", "b_actual_unit": "b_unit"}).drop("a_converted_utc", "b_release_timestamp_utc")
    # release dates of all periods, outside the window too; A's count before B's
    known = dated.where("reference_period is not null").select("event_family", "release_bundle", F.col("reference_period").alias("period"), F.col("date").alias("release_date"), F.when(is_a, 0).otherwise(1).alias("source_rank"), F.lit(None).cast("long").alias("release_no"))
    ranked = r.select("event_family", "release_bundle", "period", F.lit(None).cast("date").alias("release_date"), F.lit(2).alias("source_rank"), "release_no")
    prior = prior_release_dates(known.unionByName(ranked)).where("release_no is not null").select("release_no", "event_family", "previous_period", "previous_release_date")
    r = r.join(prior, ["release_no", "event_family"], "left")
    v = official.select("event_family", "period", "vintage_date", "value")
    r = release_vintage(r, v, ["event_family", "period"], "release_date", "vintage_date", "value", max_lag_days)
    r = r.withColumnsRenamed({"vintage_code": "release_vintage_code", "vintage_value": "official_value", "vintage_date": "official_vintage_date"})
    # the unit is that of the vintage itself; one that was told in two units has none
    told = official.groupBy("event_family", "period", F.col("vintage_date").alias("official_vintage_date")).agg(F.when(F.count_distinct("unit") == 1, F.max("unit")).otherwise("UNKNOWN").alias("official_unit"))
    r = r.join(told, ["event_family", "period", "official_vintage_date"], "left").withColumn("previous", F.coalesce("a_previous", "b_previous")).withColumn("revised_previous", F.coalesce("a_revised_previous", "b_revised_previous"))
    r = reconciled(prior_validation(r, v, max_lag_days).withColumnRenamed("release_vintage_code", "vintage_code"))
    status = F.when(ambiguous, "AMBIGUOUS_CANDIDATES").otherwise(F.col("source_match_status"))
    trusted = F.coalesce("a_ts", "b_ts") if timezone_trusted else F.col("a_ts")
    basis = F.when(F.col("a_ts").isNotNull(), "CALENDAR_A").when(trusted.isNotNull(), "CALENDAR_B_VALIDATED_ZONE")
    key = F.concat_ws(":", "event_family", F.coalesce(F.date_format("period", "yyyy-MM"), F.lit("unknown-period")))
    made = {"source_match_status": status, "trusted_release_timestamp_utc": trusted, "trusted_release_timestamp_basis": basis, "canonical_event_id": key}
    made |= {"a_rows": F.col("n_a"), "b_rows": F.col("n_b"), "sources_present": F.array_join(F.array_compact(F.array(F.when(F.col("n_a") > 0, "A"), F.when(F.col("n_b") > 0, "B"), F.when(F.col("official_value").isNotNull(), "OFFICIAL"))), "+")}
    made |= {"release_timestamp_ny": F.from_utc_timestamp(trusted, NY), "a_minus_b": F.when(F.col("a_unit") == F.col("b_unit"), F.col("a_actual") - F.col("b_actual")), "b_minus_official": F.when(F.col("b_unit") == F.col("official_unit"), F.col("b_actual") - F.col("official_value"))}
    for side in "ab":
        made[f"{side}_actual_match_status"] = official_status(F.col("official_value"), F.col(f"{side}_actual"), F.col("official_unit"), F.col(f"{side}_unit"))
    lag = F.datediff("official_vintage_date", "release_date")
    made |= {"official_vintage_lag_days": lag, "notes": _notes(ambiguous, lag, timezone_trusted)}
    out = r.withColumns(made)
    return out.orderBy(F.coalesce(F.date_format("trusted_release_timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss"), F.col("release_date").cast("string"), F.lit("9999")), "event_family", "release_no")


def undated(calendars: DataFrame, start: str, end: str, months: int = 2) -> DataFrame:
    """(source, n): rows without any release date that may belong to [start, end], as their period is unknown or about then. They are in no release."""
    lost = calendars.where("release_timestamp_utc is null and converted_utc is null")
    near = F.col("reference_period").isNull() | F.col("reference_period").between(F.date_sub(F.lit(start).cast("date"), 31 * months), F.lit(end).cast("date"))
    return lost.where(near).groupBy("source").agg(F.count("*").alias("n"))


def official_summary(events: DataFrame) -> DataFrame:
    """(event_family, status, n) of the comparisons with official release vintages."""
    return events.groupBy("event_family", F.col("actual_vs_official_release_vintage").alias("status")).agg(F.count("*").alias("n"))


def require_single_family(events: DataFrame) -> str:
    """The one family of the rows; raises if there are several or none."""
    found = [r[0] for r in events.select("event_family").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"rows of one family are needed, not of {found}")
    return found[0]
