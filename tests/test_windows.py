"""Windows around releases, against a loop over the bars."""

import datetime as dt
import math
import random

import pytest

from helpers import BAR, MINUTE, UTC, extended_hours, ny, rows
from tidemark.operators.windows import METRICS, WindowSpec, release_windows
from tidemark.sources.registry import parse_registry, registry_frame
from tidemark.sources.sessions import session_frame, sessions

#: A Wednesday two days before the clocks of New York and the exchange's holiday calendar matter; the Friday after is a holiday.
DAY, HOLIDAY = dt.date(2022, 4, 13), dt.date(2022, 4, 15)
SPEC = WindowSpec(pre=(7, 3), post=(1, 4, 11))


def entry(name, cls, day, start, end, symbols=("AAA",)):
    at = lambda c: ny(day, *map(int, c.split(":")))
    return {
        "id": name, "classification": cls, "status": "observed", "symbols": list(symbols), "provider": "alpaca", "feed": "sip", "date": day, "timezone": "America/New_York", "start_local": start, "end_local": end,
        "start_utc": at(start), "end_utc": at(end), "evidence": "seen", "source": "test", "retry_appropriate": False, "invalidates_event_window": cls == "provider_gap",
    }


def run(spark, releases, bars, entries=(), spec=SPEC, **more):
    """{(release, window): row}; releases: (id, symbol, instant)."""
    reg = registry_frame(spark, parse_registry({"schema_version": 1, "registry_version": 1, "entries": list(entries)}))
    rel = spark.createDataFrame(releases, "release_id string, symbol string, release_ts timestamp")
    out = release_windows(rel, spark.createDataFrame(bars, BAR), session_frame(spark, dt.date(2021, 12, 1), dt.date(2022, 5, 31)), reg, spec=spec, **more)
    return {(r["release_id"], r["window"]): r for r in rows(out)}


def measured_by_loop(bars, symbol, t, first, last, halted=()):
    """Counts and metrics of the window of offsets first .. last, over minutes that are not halted."""
    by = {b[1]: b for b in bars if b[0] == symbol}
    floor = t.replace(second=0, microsecond=0)
    minutes = [floor + k * MINUTE for k in range(first, last + 1) if floor + k * MINUTE not in halted]
    anchor = floor + (first - 1) * MINUTE
    found = [by.get(m) for m in minutes]
    out = {"n_expected_bars": len(minutes) + 1, "n_observed_bars": sum(b is not None for b in found) + (anchor in by)}
    if None in found or anchor not in by:
        return out | {m: None for m in METRICS if m != "volume_rel"}
    px, closes = by[anchor][5], [by[anchor][5]] + [b[5] for b in found]
    ret, high, low = closes[-1] / px - 1, max(b[3] for b in found) / px - 1, min(b[4] for b in found) / px - 1
    steps = [math.log(b / a) for a, b in zip(closes, closes[1:])]
    return out | {
        "ret": ret, "logret": math.log(closes[-1] / px), "high_exc": high, "low_exc": low, "range": high - low, "rv_abs": sum(map(abs, steps)), "rv_sq": sum(x * x for x in steps), "volume": sum(b[6] for b in found),
        "mfe": high if ret > 0 else -low if ret < 0 else None, "mae": max(0.0, -low) if ret > 0 else max(0.0, high) if ret < 0 else None,
    }


def test_windows_of_many_releases(spark):
    """Two symbols, dropped minutes, releases at and between minutes, before, in and after the session."""
    rng = random.Random(17)
    gone = {ny(DAY, 4) + k * MINUTE for k in rng.sample(range(960), 45)}
    bars = extended_hours("AAA", DAY, 3, gone) + extended_hours("BBB", DAY, 4, gone)
    releases = [(f"r{k}", rng.choice(["AAA", "BBB"]), ny(DAY, 4, 30) + dt.timedelta(seconds=rng.choice([0, 0, 17, 59]), minutes=rng.randrange(880))) for k in range(40)]
    got = run(spark, releases, bars)
    assert len(got) == 40 * 5
    for name, symbol, t in releases:
        for window, side, first, last in SPEC.offsets():
            r, want = got[name, window], measured_by_loop(bars, symbol, t, first, last)
            assert {k: r[k] for k in want} == {k: v if v is None or isinstance(v, int) else pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in want.items()}, (name, window)
            assert r["status"] == ("insufficient_market_window" if want["ret"] is None else "ok")
            assert r["coverage"] == pytest.approx(want["n_observed_bars"] / want["n_expected_bars"])
            floor = t.replace(second=0)
            assert r["release_bar_straddles_release"] == (t != floor) and r["anchor_bar_utc"].replace(tzinfo=UTC) == floor + (first - 1) * MINUTE
            clock = t.astimezone(ny(DAY, 0).tzinfo)
            minute = (t - ny(DAY, 0)).seconds // 60
            assert clock and r["release_session_state"] == ("premarket" if minute < 570 else "regular" if minute < 960 else "after_hours")
    spans = {w: (a, z) for w, _, a, z in SPEC.offsets()}
    assert spans == {"pre7m": (-7, -1), "pre3m": (-3, -1), "post1m": (0, 0), "post4m": (0, 3), "post11m": (0, 10)}


def test_status_precedence(spark):
    """A gap touches some windows only; a halt shrinks what is due; a holiday closes; later data than the research end is provisional; no time, no window."""
    halted = {ny(DAY, 14, 2) + k * MINUTE for k in range(6)}
    bars = extended_hours("AAA", DAY, 5, halted) + extended_hours("AAA", HOLIDAY, 6)
    entries = [entry("hole", "provider_gap", DAY, "11:03", "11:20"), entry("pause", "market_wide_halt", DAY, "14:02", "14:08", ["*"])]
    got = run(spark, [("gap", "AAA", ny(DAY, 11)), ("halt", "AAA", ny(DAY, 14)), ("shut", "AAA", ny(HOLIDAY, 11)), ("none", "AAA", None), ("empty", "BBB", ny(DAY, 11))], bars, entries)
    assert {w: got["gap", w]["status"] for _, w in got if (_, w)[0] == "gap"} == {"pre7m": "ok", "pre3m": "ok", "post1m": "ok", "post4m": "provider_gap_in_window", "post11m": "provider_gap_in_window"}
    assert got["gap", "post4m"]["exception_ids"] == ["hole"] and got["gap", "post4m"]["ret"] is None and got["gap", "pre7m"]["exception_ids"] == []
    long_ = got["halt", "post11m"]
    want = measured_by_loop(bars, "AAA", ny(DAY, 14), 0, 10, halted)
    assert long_["status"] == "ok_market_halt" and {k: long_[k] for k in want} == {k: v if isinstance(v, int) else pytest.approx(v) for k, v in want.items()}
    assert long_["volume_rel_status"] == "not_comparable_excluded_minutes" and got["halt", "post1m"]["status"] == "ok"
    assert {got["shut", w]["status"] for w in ("pre3m", "post4m")} == {"exchange_closed"} and got["shut", "post1m"]["release_session_state"] == "closed_day"
    assert {r["status"] for (i, _), r in got.items() if i == "none"} == {"no_release_time"} and sum(i == "none" for i, _ in got) == 5
    assert {r["status"] for (i, _), r in got.items() if i == "empty"} == {"insufficient_market_window"}
    early = run(spark, [("gap", "AAA", ny(DAY, 11))], bars, entries, research_end="2022-04-12")
    assert early["gap", "post1m"]["status"] == "provisional_market_data" and early["gap", "post4m"]["status"] == "provider_gap_in_window"


def test_comparable_volume(spark):
    """The mean over the latest complete, undisturbed earlier sessions at the same wall clock, over a change of the clocks, by a loop."""
    days = [d for d, _, _ in sessions(dt.date(2022, 2, 28), dt.date(2022, 4, 12))][-26:]
    assert days[0] < dt.date(2022, 3, 13) < days[-1]
    t = lambda d: ny(d, 9, 50)
    broken, gapped = days[-2], days[-5]
    drop = {t(broken) + 2 * MINUTE}
    bars = [b for k, d in enumerate([*days, DAY]) for b in extended_hours("AAA", d, 100 + k, drop if d == broken else ())]
    spec = WindowSpec(pre=(), post=(4,), baseline_sessions=8, baseline_min=5, baseline_lookback=12)
    got = run(spark, [("r", "AAA", t(DAY))], bars, [entry("hole", "provider_gap", gapped, "09:51", "09:52")], spec)["r", "post4m"]
    volume = lambda d: sum(b[6] for b in bars if t(d) <= b[1] < t(d) + 4 * MINUTE)
    usable = [d for d in days[-12:] if d not in (broken, gapped)][-8:]
    assert got["volume_rel_n_windows"] == 8 and got["volume_rel"] == pytest.approx(volume(DAY) / (sum(map(volume, usable)) / 8))
    few = run(spark, [("r", "AAA", t(DAY))], [b for b in bars if b[1] >= ny(days[-3], 0)], [], spec)["r", "post4m"]
    assert (few["volume_rel"], few["volume_rel_status"], few["volume_rel_n_windows"]) == (None, "insufficient_comparable_history", 2)


def test_what_comes_later_changes_nothing(spark):
    bars = extended_hours("AAA", DAY, 8)
    t = ny(DAY, 12, 20)
    other = [b if b[1] < t + 4 * MINUTE else (*b[:2], *(x * 37 for x in b[2:])) for b in bars]
    a, b = run(spark, [("r", "AAA", t)], bars), run(spark, [("r", "AAA", t)], other)
    assert all(a["r", w] == b["r", w] for w in ("pre7m", "pre3m", "post1m", "post4m")) and a["r", "post11m"] != b["r", "post11m"]


def test_exchange_calendar():
    open_days = lambda y: [d for d, _, _ in sessions(dt.date(y, 1, 1), dt.date(y, 12, 31))]
    n = {y: len(open_days(y)) for y in range(2016, 2026)}
    assert n == {2016: 252, 2017: 251, 2018: 251, 2019: 252, 2020: 253, 2021: 252, 2022: 251, 2023: 250, 2024: 252, 2025: 250}
    assert HOLIDAY not in open_days(2022) and dt.date(2022, 6, 20) not in open_days(2022) and dt.date(2021, 6, 18) in open_days(2021)
    lengths = {d: (b - a).seconds // 60 for d, a, b in sessions(dt.date(2023, 11, 20), dt.date(2023, 11, 30))}
    assert lengths[dt.date(2023, 11, 24)] == 210 and lengths[dt.date(2023, 11, 27)] == 390
