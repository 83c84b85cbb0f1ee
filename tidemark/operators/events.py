"""The event table: release identity, status of the release time, exclusion with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import coalesced_status, official_status
from ..functions.times import NY

USABLE = "usable"
AMBIGUOUS, CONFLICT, NONSTANDARD = "excluded_ambiguous_timestamp", "excluded_timestamp_conflict", "excluded_nonstandard_release_time"
UNSCHEDULED, AFTER_END = "unscheduled_release", "after_research_end"


def usable_event() -> Column:
    return F.col("event_status") == USABLE


def usable_response(window: str) -> Column:
    return usable_event() & F.col(f"{window}_status").isin("ok", "ok_market_halt") & F.col(f"{window}_ret").isNotNull()


def usable_std_surprise() -> Column:
    return usable_event() & (F.col("surprise_std_status") == "ok") & F.col("surprise_std").isNotNull()


def trusted_time() -> Column:
    return (F.col("timestamp_quality") == "CONFIRMED") & F.col("release_timestamp_utc").isNotNull()


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: that with the greatest order value. By max_by over the whole row, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def with_release_status(events: DataFrame, families: DataFrame, research_end: str, fomc_family: str = "FED_FUNDS_RATE") -> DataFrame:
    """release_time_et, release_date_et, release_time_status, event_status, event_status_reason, concurrent_families.

    events: event_id, event_family, release_bundle, release_timestamp_utc, timestamp_quality, forecast. families (broadcast; tens of rows): event_family,
    expected_release_times_et. Precedence: ambiguous time, unscheduled policy decision, conflict with the bundle's other members that day or nonstandard time, after the end, usable.
    """
    e = events.join(F.broadcast(families.select("event_family", "expected_release_times_et")), "event_family")
    timed = trusted_time()
    local = F.from_utc_timestamp("release_timestamp_utc", NY)
    e = e.withColumns({
        "release_time_et": F.when(timed, F.date_format(local, "HH:mm")), "release_date_et": F.when(timed, F.date_format(local, "yyyy-MM-dd")),
        "release_id": F.when(timed, F.col("release_timestamp_utc")),
    })
    standard = F.array_contains("expected_release_times_et", F.col("release_time_et"))
    e = e.withColumn("__standard", standard)
    # conflicts: members of the same bundle on the same day at a standard time of this row's family; distinct (day, bundle, time, id) per pair are few
    others = e.where("release_time_et is not null").groupBy("release_date_et", "release_bundle", "release_time_et").agg(F.count("*").alias("n")).groupBy("release_date_et", "release_bundle").agg(F.map_from_entries(F.collect_list(F.struct("release_time_et", "n"))).alias("__times"))
    e = e.join(others, ["release_date_et", "release_bundle"], "left")
    clash = F.filter(F.map_keys("__times"), lambda t: F.array_contains(F.col("expected_release_times_et"), t) & (t != F.col("release_time_et")))
    e = e.withColumn("__clash", F.array_sort(F.coalesce(clash, F.array().cast("array<string>"))))
    fomc = F.col("event_family") == fomc_family
    unscheduled = fomc & (~F.col("__standard") | F.col("forecast").isNull())
    after = F.col("release_date_et") > F.lit(research_end)
    status = coalesced_status(
        (F.col("release_time_et").isNull(), AMBIGUOUS),
        (unscheduled, UNSCHEDULED),
        (~F.col("__standard") & (F.size("__clash") > 0), CONFLICT),
        (~F.col("__standard"), NONSTANDARD),
        (after, AFTER_END),
        otherwise=USABLE,
    )
    at = F.col("release_time_et")
    reason = (
        F.when(status == AMBIGUOUS, F.concat(F.lit("timestamp_quality="), F.coalesce("timestamp_quality", F.lit("null"))))
        .when(status == UNSCHEDULED, F.concat(F.lit("policy action at "), at, F.when(F.col("forecast").isNull(), " without a forecast").otherwise("")))
        .when(status == CONFLICT, F.concat(at, F.lit(" contradicts the bundle's "), F.concat_ws(", ", "__clash")))
        .when(status == NONSTANDARD, F.concat(at, F.lit(" is no documented release time")))
        .when(status == AFTER_END, F.lit(f"after {research_end}"))
    )
    time_status = F.when(at.isNull(), "missing").when(unscheduled, "unscheduled").when(F.col("__standard"), "standard").otherwise("nonstandard")
    e = e.withColumns({"event_status": status, "event_status_reason": reason, "release_time_status": time_status})
    same = e.where("release_id is not null").groupBy("release_id").agg(F.array_join(F.array_sort(F.collect_list("event_family")), ",").alias("concurrent_families"))
    return e.join(same, "release_id", "left").drop("__standard", "__times", "__clash", "expected_release_times_et")


def with_official(events: DataFrame, official: DataFrame) -> DataFrame:
    """The official release-vintage number of each event (official: event_id, official_value, official_unit, position; the last position wins) and how it compares."""
    one = last_wins(official, ["event_id"], "position").select("event_id", "official_value", "official_unit")
    out = events.join(one, "event_id", "left")
    status = official_status(F.col("official_value"), F.col("actual"), F.col("official_unit"), F.col("actual_unit"))
    pit = F.when(status.isin("exact_match", "rounding_match"), "official_release_vintage_verified").when(status == "value_mismatch", "official_release_vintage_mismatch").otherwise("unverified")
    return out.withColumns({"actual_vs_official_release_vintage": status, "actual_point_in_time_status": pit})


def release_level(rows: DataFrame) -> DataFrame:
    """One row for each (release_id, symbol): per column the first present value by event_id, the member families and their number."""
    rest = [c for c in rows.columns if c not in ("release_id", "symbol", "event_family", "event_id")]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("event_id"))).alias(c) for c in rest]
    return rows.groupBy("release_id", "symbol").agg(F.array_join(F.array_sort(F.collect_list("event_family")), ",").alias("member_families"), F.count("*").alias("n_members"), *first)
