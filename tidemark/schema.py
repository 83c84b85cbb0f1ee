"""Row types (column order and types) of the tables the engine reads and makes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A stored minute bar.
BAR_RAW = "timestamp_utc timestamp, open double, high double, low double, close double, volume double, vwap double, transactions long"
#: A canonical bar: with identity and provenance.
BAR = BAR_RAW + (
    ", symbol string, source string, feed string, feed_scope string, timeframe string, adjustment string, retrieval_timestamp_utc timestamp, "
    "normalized_at_utc timestamp, raw_artifact_checksum string, raw_artifact_path string"
)
#: A calendar event of any source.
MACRO_EVENT = (
    "event_id string, event_family string, indicator string, release_bundle string, reference_period date, release_timestamp_utc timestamp, "
    "release_timestamp_ny timestamp, source_timestamp timestamp_ntz, source_timezone string, timestamp_quality string, actual double, "
    "provider_forecast double, previous double, revised_previous double, actual_unit string, provider_forecast_unit string, previous_unit string, "
    "actual_raw_text string, provider_forecast_raw_text string, previous_raw_text string, forecast_source string, official_actual double, "
    "official_actual_unit string, official_source string, official_vintage_kind string, official_vintage_date date, unit string, importance string, "
    "source string, source_event_id string, source_url string, raw_artifact_checksum string, retrieval_timestamp_utc timestamp, normalized_at_utc timestamp"
)
SESSION = "ny_date date, open timestamp, close timestamp"
EXCEPTION = (
    "id string, classification string, status string, symbols array<string>, provider string, feed string, date date, timezone string, start_local string, "
    "end_local string, start_utc timestamp, end_utc timestamp, retry_appropriate boolean, invalidates_event_window boolean, evidence string, source string, notes string"
)
MANIFEST = (
    "provider string, key string, status string, checksum string, path string, error string, start date, end date, rows long, retrieved_at timestamp, "
    "verified_at timestamp, request_meta map<string,string>, known_exception_ids array<string>"
)
TIMESTAMP_QUALITIES = ("CONFIRMED", "ASSUMED", "TENTATIVE", "UNRESOLVED")
UNITS = ("PERCENT", "THOUSANDS", "LEVEL", "UNKNOWN")
SOURCES = ("MQL5", "FOREX_FACTORY", "FRED", "BLS")


def fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of each column; needs no session."""
    return [tuple(x.split(" ", 1)) for x in re.split(r", (?=\w+ )", ddl)]


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of ddl in its order and types; absent ones null. A naive timestamp where an instant is asked for is refused."""
    have = dict(df.dtypes)
    out = []
    for name, kind in fields(ddl):
        if kind == "timestamp" and have.get(name) == "timestamp_ntz":
            raise ValueError(f"{name} is a naive timestamp; it is never assumed to be UTC")
        c = F.col(name) if name in have else F.lit(None)
        out.append(c.cast({"long": "bigint"}.get(kind, kind)).alias(name))
    return df.select(*out)
