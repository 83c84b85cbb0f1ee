"""The registry of known market-data exceptions: loading, checks, and what a window meets.

Intervals are half-open over bar start times. An entry is classified, never used to fill anything.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Iterable
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import DAY_US, long
from ..schema import EXCEPTION, fields

#: Classes, evidence levels, and the classes whose minutes are not expected to have bars.
CLASSES = ("exchange_closed", "market_wide_halt", "provider_gap", "temporary_fetch_failure", "legitimate_no_trade_interval")
STATUSES = ("observed", "reobserved", "authoritative", "retired")
NOT_EXPECTED = ("exchange_closed", "market_wide_halt", "legitimate_no_trade_interval")
TAGS = {
    "provider_gap": "provider_gap_in_window",
    "market_wide_halt": "market_halt_in_window",
    "exchange_closed": "exchange_closed_in_window",
    "legitimate_no_trade_interval": "no_trade_interval_in_window",
    "temporary_fetch_failure": "temporary_fetch_failure_in_window",
}
_FIELDS = [name for name, _ in fields(EXCEPTION)]


class RegistryError(ValueError):
    pass


def _instant(value: object, name: str, key: str) -> dt.datetime:
    at = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    if at.tzinfo is None:
        raise RegistryError(f"{key}: {name} has no time zone")
    return at.astimezone(dt.timezone.utc)


def parse_entry(raw: dict) -> dict:
    """One checked entry; every fault raises RegistryError with the entry's id."""
    key = str(raw.get("id") or "")
    if not key:
        raise RegistryError("an entry has no id")
    for name in ("classification", "status", "symbols", "provider", "feed", "start_utc", "end_utc", "evidence", "source"):
        if raw.get(name) in (None, "", []):
            raise RegistryError(f"{key}: {name} is missing")
    if raw["classification"] not in CLASSES:
        raise RegistryError(f"{key}: unknown classification {raw['classification']}")
    if raw["status"] not in STATUSES:
        raise RegistryError(f"{key}: unknown status {raw['status']}")
    if raw["classification"] == "provider_gap" and "*" in (raw["provider"], raw["feed"]):
        raise RegistryError(f"{key}: a gap is of one provider and feed")
    for name in ("retry_appropriate", "invalidates_event_window"):
        if not isinstance(raw.get(name), bool):
            raise RegistryError(f"{key}: {name} is not a boolean")
    if raw["classification"] == "temporary_fetch_failure" and not raw["retry_appropriate"]:
        raise RegistryError(f"{key}: a temporary failure is worth a retry")
    for name in ("evidence", "source"):
        if not str(raw[name]).strip():
            raise RegistryError(f"{key}: {name} is blank")
    symbols = [raw["symbols"]] if isinstance(raw["symbols"], str) else [str(s) for s in raw["symbols"]]
    start, end = _instant(raw["start_utc"], "start_utc", key), _instant(raw["end_utc"], "end_utc", key)
    if end <= start:
        raise RegistryError(f"{key}: end is not after start")
    try:
        zone = ZoneInfo(str(raw.get("timezone") or ""))
        day = raw.get("date")
        day = day if isinstance(day, dt.date) else dt.date.fromisoformat(str(day))
        clocks = [dt.time.fromisoformat(str(raw.get(name))) for name in ("start_local", "end_local")]
    except (ValueError, KeyError, OSError) as fault:
        raise RegistryError(f"{key}: {fault}") from None
    # both bounds, told twice, must be the same instants
    for clock, at in zip(clocks, (start, end)):
        if dt.datetime.combine(day, clock, zone).astimezone(dt.timezone.utc) != at:
            raise RegistryError(f"{key}: {day} {clock} {zone.key} is not {at.isoformat()}")
    return {
        **{n: raw.get(n) for n in _FIELDS}, "id": key, "symbols": symbols, "date": day, "start_utc": start, "end_utc": end, "timezone": zone.key,
        "evidence": str(raw["evidence"]).strip(), "source": str(raw["source"]).strip(), "notes": str(raw.get("notes") or "").strip(),
    }


def parse_registry(raw: dict) -> list[dict]:
    if raw.get("schema_version") != 1 or not isinstance(raw.get("registry_version"), int):
        raise RegistryError("schema_version must be 1 and registry_version an integer")
    found = [parse_entry(e) for e in raw.get("entries") or []]
    if len({e["id"] for e in found}) != len(found):
        raise RegistryError("two entries have the same id")
    return found


def content_hash(parsed: Iterable[dict]) -> str:
    """The same for any order and file format."""
    rows = sorted(json.dumps(e, sort_keys=True, default=lambda v: v.isoformat()) for e in parsed)
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def registry_frame(spark: SparkSession, parsed: Iterable[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(e[n] for n in _FIELDS) for e in parsed], EXCEPTION)


def day_index(registry: DataFrame, provider: str, feed: str) -> DataFrame:
    """The active entries that speak of provider and feed, columns prefixed x_, cut up for equi-joins: a row for each scope (a symbol, or `*` for entries of all) and UTC day that an entry touches."""
    x = registry.select(*[F.col(c).alias(f"x_{c}") for c in registry.columns])
    x = x.where((F.col("x_status") != "retired") & F.col("x_provider").isin("*", provider) & F.col("x_feed").isin("*", feed) & (F.col("x_start_utc") < F.col("x_end_utc")))
    scopes = F.when(F.array_contains("x_symbols", "*"), F.array(F.lit("*"))).otherwise(F.array_distinct("x_symbols"))
    x = x.withColumns({"x_from": F.unix_micros("x_start_utc"), "x_to": F.unix_micros("x_end_utc"), "x_scope": F.explode(scopes)})
    return x.withColumn("x_day", F.explode(F.sequence(day_of(F.col("x_from")), day_of(F.col("x_to") - 1))))


def day_of(us: Column) -> Column:
    """The UTC day that an instant in microseconds falls on, by number."""
    return F.floor(us / long(DAY_US))


def met(rows: DataFrame, registry: DataFrame, symbol: Column, from_us: Column, to_us: Column, provider: str, feed: str, how: str = "inner") -> DataFrame:
    """rows joined with the entries that overlap [from_us, to_us), by equality of scope and day; each pair comes once, on the first day that both touch.

    With how="left", rows are repeated for their days and scopes whether they meet an entry or not; with "left_semi" they come at most once for each of these. The planner broadcasts a small registry by its size; a large one is shuffled.
    """
    cut = rows.withColumns({"__from": from_us, "__to": to_us}).withColumn("__day", F.explode_outer(F.sequence(day_of(F.col("__from")), day_of(F.greatest(F.col("__to") - 1, F.col("__from"))))))
    cut = cut.withColumn("__scope", F.explode(F.array(symbol, F.lit("*"))))
    first = F.greatest(day_of(F.col("__from")), day_of(F.col("x_from")))
    pair = (F.col("__scope") == F.col("x_scope")) & (F.col("__day") == F.col("x_day")) & (F.col("__from") < F.col("x_to")) & (F.col("x_from") < F.col("__to")) & (F.col("__day") == first)
    return cut.join(day_index(registry, provider, feed), pair, how).drop("__from", "__to", "__day", "__scope")


def query_windows(windows: DataFrame, registry: DataFrame, key: list[str], start: str, end: str, provider: str = "alpaca", feed: str = "sip", symbol: str = "symbol") -> DataFrame:
    """For each window: exception_ids, exception_tags (sorted arrays), has_provider_gap, has_market_halt, has_exchange_closed, invalidated."""
    hit = met(windows, registry, F.col(symbol), F.unix_micros(start), F.unix_micros(end), provider, feed, "left")
    tag = F.lit(None).cast("string")
    for name, said in TAGS.items():
        tag = F.when(F.col("x_classification") == name, said).otherwise(tag)
    has = lambda name: F.coalesce(F.bool_or(F.col("x_classification") == name), F.lit(False))
    return hit.groupBy(*key).agg(
        F.array_sort(F.collect_set("x_id")).alias("exception_ids"),
        F.array_sort(F.collect_set(F.when(F.col("x_id").isNotNull(), tag))).alias("exception_tags"),
        has("provider_gap").alias("has_provider_gap"),
        has("market_wide_halt").alias("has_market_halt"),
        has("exchange_closed").alias("has_exchange_closed"),
        F.coalesce(F.bool_or("x_invalidates_event_window"), F.lit(False)).alias("invalidated"),
    )


def minutes_in(bars: DataFrame, registry: DataFrame, ts: str = "timestamp_utc", provider: str = "alpaca", feed: str = "sip", symbol: str = "symbol") -> DataFrame:
    """The bars that start inside an entry, once for each entry that covers them, with x_id and x_classification."""
    at = F.unix_micros(ts)
    return met(bars, registry, F.col(symbol), at, at + 1, provider, feed).select(*bars.columns, "x_id", "x_classification")
