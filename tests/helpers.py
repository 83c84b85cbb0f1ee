"""Bars for the tests: random walks on a minute grid, and plain loops that measure them."""

from __future__ import annotations

import datetime as dt
import random
from zoneinfo import ZoneInfo

UTC, NY = dt.timezone.utc, ZoneInfo("America/New_York")
BAR = "symbol string, timestamp_utc timestamp, open double, high double, low double, close double, volume double"
MINUTE = dt.timedelta(minutes=1)


def ny(day: dt.date, hour: int, minute: int = 0, second: int = 0) -> dt.datetime:
    return dt.datetime(day.year, day.month, day.day, hour, minute, second, tzinfo=NY).astimezone(UTC)


def walk(symbol: str, start: dt.datetime, end: dt.datetime, seed: int, drop=()) -> list[tuple]:
    """A bar for each minute of [start, end) but those in drop. Prices and volumes depend on the seed alone, not on what is dropped."""
    rng, price, out, at = random.Random(seed), 80.0 + seed % 50, [], start
    while at < end:
        opened, price = price, round(price * (1 + rng.gauss(0, 4e-4)), 4)
        high, low = max(opened, price) + round(rng.random() / 20, 4), min(opened, price) - round(rng.random() / 20, 4)
        volume = float(int(rng.lognormvariate(5, 1)))
        if at not in drop:
            out.append((symbol, at, opened, high, low, price, volume))
        at += MINUTE
    return out


def extended_hours(symbol: str, day: dt.date, seed: int, drop=()) -> list[tuple]:
    return walk(symbol, ny(day, 4), ny(day, 20), seed, drop)


def rows(df, *order) -> list[dict]:
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]
