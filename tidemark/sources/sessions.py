"""The New York Stock Exchange's sessions, made from its public holiday rules."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession

from ..schema import SESSION

_NY = ZoneInfo("America/New_York")
#: Closures outside the rules, 2016 to 2026. Other years need more of them.
ONE_OFF_CLOSURES = (dt.date(2018, 12, 5), dt.date(2025, 1, 9))
FIRST_JUNETEENTH = 2022


def easter(year: int) -> dt.date:
    """Western Easter Sunday (anonymous Gregorian computus)."""
    a, b, c = year % 19, year // 100, year % 100
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = (a + 11 * h + 22 * m) // 451
    month, day = divmod(h + m - 7 * n + 114, 31)
    return dt.date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th weekday of a month; n = -1 the last."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


def _observed(day: dt.date) -> dt.date:
    return day + dt.timedelta({5: -1, 6: 1}.get(day.weekday(), 0))


def holidays(year: int) -> set[dt.date]:
    new_year = dt.date(year, 1, 1)
    days = {
        _nth(year, 1, 0, 3), _nth(year, 2, 0, 3), easter(year) - dt.timedelta(2), _nth(year, 5, 0, -1), _observed(dt.date(year, 7, 4)),
        _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _observed(dt.date(year, 12, 25)),
    }
    if new_year.weekday() != 5:  # on a Saturday it is not observed at all
        days.add(_observed(new_year))
    if year >= FIRST_JUNETEENTH:
        days.add(_observed(dt.date(year, 6, 19)))
    return days | {d for d in ONE_OFF_CLOSURES if d.year == year}


def early_closes(year: int) -> set[dt.date]:
    off = holidays(year)
    days = {_nth(year, 11, 3, 4) + dt.timedelta(1), dt.date(year, 7, 3), dt.date(year, 12, 24)}
    return {d for d in days if d.weekday() < 5 and d not in off}


def sessions(first: dt.date, last: dt.date) -> list[tuple[dt.date, dt.datetime, dt.datetime]]:
    out = []
    for year in range(first.year, last.year + 1):
        off, early = holidays(year), early_closes(year)
        day = max(first, dt.date(year, 1, 1))
        while day <= min(last, dt.date(year, 12, 31)):
            if day.weekday() < 5 and day not in off:
                at = lambda h, m: dt.datetime(day.year, day.month, day.day, h, m, tzinfo=_NY).astimezone(dt.timezone.utc)  # noqa: E731, B023
                out.append((day, at(9, 30), at(13, 0) if day in early else at(16, 0)))
            day += dt.timedelta(1)
    return out


def session_frame(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """(ny_date, open, close); some 250 rows a year, so always small enough to broadcast."""
    return spark.createDataFrame(sessions(first, last), SESSION)
