"""Instants, wall clocks and calendar arithmetic as Column expressions. Instants are `timestamp`, wall clocks `timestamp_ntz` or text."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NY = "America/New_York"
MINUTE_US = 60_000_000
DAY_US = 24 * 60 * MINUTE_US


def long(n: int) -> Column:
    """A 64-bit literal; products of small integers with microseconds overflow otherwise."""
    return F.lit(n).cast("long")


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp; of a naive one as if it were UTC (for arithmetic on one clock only)."""
    return F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c)


def floor_minute(c: Column) -> Column:
    return F.date_trunc("MINUTE", c)


def ceil_minute(c: Column) -> Column:
    low = floor_minute(c)
    return F.when(low == c, low).otherwise(low + F.expr("interval 1 minute"))


def ny_date(c: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(c, NY))


def ny_minute_of_day(c: Column) -> Column:
    local = F.from_utc_timestamp(c, NY)
    return F.hour(local) * 60 + F.minute(local)


def clock_session(c: Column) -> Column:
    """By New York wall clock and weekday alone: CLOSED, PREMARKET (from 4:00), REGULAR (9:30 to 16:00), AFTER_HOURS (to 20:00)."""
    m, weekend = ny_minute_of_day(c), F.dayofweek(F.from_utc_timestamp(c, NY)).isin(1, 7)
    return (
        F.when(weekend, "CLOSED").when((m >= 240) & (m < 570), "PREMARKET").when((m >= 570) & (m < 960), "REGULAR").when((m >= 960) & (m < 1200), "AFTER_HOURS").otherwise("CLOSED")
    )


def session_state(c: Column, open_: Column, close: Column) -> Column:
    """By the exchange calendar: closed_day, regular, premarket, after_hours, overnight. open_ and close are null on days without a session."""
    m = ny_minute_of_day(c)
    return (
        F.when(open_.isNull(), "closed_day")
        .when((c >= open_) & (c < close), "regular")
        .when((m >= 240) & (c < open_), "premarket")
        .when((c >= close) & (m < 1200), "after_hours")
        .otherwise("overnight")
    )


def prior_month(c: Column) -> Column:
    """First day of the month before: the period that a monthly release speaks of."""
    return F.add_months(F.trunc(c, "MM"), -1)


def local_to_utc(naive: Column, zone: Column | str) -> Column:
    """Wall clock in a zone to the instant; the first of two in the hour that a clock repeats."""
    return F.to_utc_timestamp(naive.cast("timestamp"), zone)


def local_to_utc_near(naive: Column, zone: str, reference: Column) -> Column:
    """struct(instant, ambiguous, nonexistent). Of the instants that show this wall clock the one nearest to the reference; for a skipped hour the instant after it."""
    wall = naive.cast("timestamp")
    first = F.to_utc_timestamp(wall, zone)
    shown = lambda t: F.from_utc_timestamp(t, zone) == wall
    hour = F.expr("interval 1 hour")
    earlier = F.when(shown(first - hour), first - hour)
    later = F.when(shown(first + hour), first + hour)
    other = F.coalesce(earlier, later)
    gap = lambda t: F.abs(F.unix_micros(t) - F.unix_micros(reference))
    nonexistent = ~shown(first) & other.isNull()
    instant = F.when(other.isNull() | reference.isNull(), first).when(gap(other) < gap(first), other).otherwise(first)
    return F.struct(instant.alias("instant"), other.isNotNull().alias("ambiguous"), nonexistent.alias("nonexistent"))


def time_of_day(text: Column) -> Column:
    """Minutes after midnight of '8:30am', '14:00' and the like; null for 'All Day', 'Tentative', 'Day 1', blanks and impossible times."""
    t = F.lower(F.trim(text))
    pattern = r"^(\d{1,2}):(\d{2})\s*(am|pm)?$"
    hour, minute, half = (F.regexp_extract(t, pattern, k) for k in (1, 2, 3))
    h, m = hour.try_cast("int"), minute.try_cast("int")
    h12 = F.when(half == "am", F.when(h == 12, 0).otherwise(h)).when(half == "pm", F.when(h == 12, 12).otherwise(h + 12)).otherwise(h)
    return F.when((m < 60) & (h12 < 24) & ((half == "") | (h.between(1, 12))), h12 * 60 + m)


def nearest_year(month: Column, day: Column, page_year: Column, page_month: Column) -> Column:
    """The year of a 'Dec 30' on a January page: the page's year, one less or one more, whichever is within half a year."""
    year = F.when((page_month <= 2) & (month >= 11), page_year - 1).when((page_month >= 11) & (month <= 2), page_year + 1).otherwise(page_year)
    return F.when(day.isNotNull(), year)


def split_of(c: Column, splits: dict[str, tuple[str, str]]) -> Column:
    """The split whose New York dates (inclusive) hold the instant; unassigned without one, outside_research_range beyond all."""
    day = ny_date(c)
    out = F.lit("outside_research_range")
    for name, (first, last) in splits.items():
        out = F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), name).otherwise(out)
    return F.when(c.isNull(), "unassigned").otherwise(out)


_TIMEFRAME = re.compile(r"^(\d+)\s*(min|minute|m|h|hour|day|d)s?$")


def timeframe_minutes(text: str) -> int:
    """'1min', '5min', '1h' in minutes; days and non-positive ones are refused."""
    m = _TIMEFRAME.match(text.strip().lower())
    if not m or int(m[1]) <= 0 or m[2] in ("day", "d"):
        raise ValueError(f"not an intraday timeframe: {text!r}")
    return int(m[1]) * (60 if m[2] in ("h", "hour") else 1)


def chunks(spark: SparkSession, start: dt.date, end: dt.date, every: str = "month") -> DataFrame:
    """(start, end) of each calendar day, month or year that touches [start, end], cut to it; both ends inclusive."""
    unit = {"day": "DD", "month": "MM", "year": "YYYY"}[every]
    one = spark.range(1).select(F.lit(start).alias("lo"), F.lit(end).alias("hi"))
    first = F.col("lo") if every == "day" else F.trunc("lo", unit)
    day = one.where("lo <= hi").select("lo", "hi", F.explode(F.sequence(first, F.col("hi"), F.expr(f"interval 1 {every}"))).alias("d"))
    after = F.date_add(F.add_months("d", {"day": 0, "month": 1, "year": 12}[every]), 0 if every == "day" else -1)
    return day.select(F.greatest("lo", "d").alias("start"), F.least("hi", after).alias("end")).orderBy("start")


def date_window(first: dt.date, last: dt.date) -> tuple[dt.datetime, dt.datetime]:
    """New York dates, both inclusive, as a half-open range of instants: constants that reach the scan as pushed filters."""
    from zoneinfo import ZoneInfo

    at = lambda d: dt.datetime.combine(d, dt.time(), ZoneInfo(NY)).astimezone(dt.timezone.utc)
    return at(first), at(last + dt.timedelta(days=1))
