import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import BAR, MINUTE, extended_hours, ny, rows
from tidemark.plans.event_study import StudySpec, report, study
from tidemark.sources.registry import registry_frame
from tidemark.sources.sessions import session_frame
from tidemark.operators.windows import WindowSpec

#: Six employment reports of 2021, and what was shown for each: two series, one value missing.
DAYS = [dt.date(2021, 2, 5), dt.date(2021, 3, 5), dt.date(2021, 5, 7), dt.date(2021, 6, 4), dt.date(2021, 7, 2), dt.date(2021, 8, 6)]
RATE = [6.3, None, 6.1, 5.8, 5.9, 5.4]
EARNINGS = [0.2, 0.2, 0.7, 0.5, 0.3, 0.4]
SYMBOLS = ("AAA", "BBB")


@pytest.fixture(scope="module")
def bars():
    return [b for k, s in enumerate(SYMBOLS) for n, d in enumerate(DAYS) for b in extended_hours(s, d, 10 * k + n)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory, bars):
    calendar = []
    for n, d in enumerate(DAYS):
        calendar.append((f"rate-{n}", "UNEMPLOYMENT_RATE", "EMPLOYMENT", ny(d, 8, 30), "CONFIRMED", RATE[n], 6.0, "PERCENT"))
        calendar.append((f"pay-{n}", "AVG_HOURLY_EARNINGS_MOM", "EMPLOYMENT", ny(d, 8, 30), "CONFIRMED", EARNINGS[n], 0.3, "PERCENT"))
    calendar.append(("late", "CPI_MOM", "CPI", ny(dt.date(2021, 9, 14), 9, 45), "CONFIRMED", 0.3, 0.4, "PERCENT"))
    calendar.append(("none", "CPI_MOM", "CPI", None, "TENTATIVE", 0.4, 0.4, "PERCENT"))
    cal = spark.createDataFrame(calendar, "event_id string, event_family string, release_bundle string, release_timestamp_utc timestamp, timestamp_quality string, actual double, provider_forecast double, actual_unit string")
    sessions = session_frame(spark, dt.date(2020, 10, 1), dt.date(2021, 10, 1))
    spec = StudySpec(min_history=3, baseline_min=2, windows=WindowSpec(pre=(5,), post=(1, 5, 30, 60)), baseline_horizons=(5,))
    e, wide, windows = study(cal, spark.createDataFrame(bars, BAR), sessions, registry_frame(spark, []), list(SYMBOLS), spec)
    at = tmp_path_factory.mktemp("study")
    e, wide, windows = (df.write.parquet(f"{at}/{n}") or spark.read.parquet(f"{at}/{n}") for n, df in (("e", e), ("wide", wide), ("windows", windows)))
    return rows(e), rows(wide), rows(windows), wide, windows, spec


def test_shapes_and_statuses(made):
    e, wide, windows, *_ = made
    assert len(e) == 14 and len(wide) == 28 and len(windows) == 7 * 2 * 5
    status = {r["event_id"]: r["event_status"] for r in e}
    assert status["late"] == "excluded_nonstandard_release_time" and status["none"] == "excluded_ambiguous_timestamp" and status["pay-0"] == "usable"
    assert {r["status"] for r in windows} == {"ok", "event_excluded"}
    w = {(r["event_id"], r["symbol"]): r for r in wide}
    assert w["none", "AAA"]["post5m_status"] == "no_release_time" and w["late", "BBB"]["post5m_status"] == "event_excluded"
    assert w["rate-3", "AAA"]["concurrent_families"] == "AVG_HOURLY_EARNINGS_MOM,UNEMPLOYMENT_RATE"


def test_history(made, bars):
    """Standard scores from earlier surprises alone, and residuals from earlier responses to surprises of the same sign, by loops."""
    e, wide, *_ = made
    z = {r["event_id"]: r for r in e}
    for name, shown, expected in (("rate", RATE, 6.0), ("pay", EARNINGS, 0.3)):
        earlier: list[float] = []
        for n, x in enumerate(shown):
            r = z[f"{name}-{n}"]
            if x is None:
                assert r["surprise_std_status"] == "missing_actual"
                continue
            if len(earlier) < 3:
                assert r["surprise_std_status"] == "insufficient_history"
            else:
                mean = sum(earlier) / len(earlier)
                deviation = (sum((v - mean) ** 2 for v in earlier) / (len(earlier) - 1)) ** 0.5
                assert r["surprise_std_status"] == "ok" and r["surprise_std"] == pytest.approx((x - expected - mean) / deviation)
            earlier.append(x - expected)
    close = {(b[0], b[1]): b[5] for b in bars}
    w = {(r["event_id"], r["symbol"]): r for r in wide}
    for symbol in SYMBOLS:
        ret = {n: close[symbol, ny(d, 8, 30) + 4 * MINUTE] / close[symbol, ny(d, 8, 30) - MINUTE] - 1 for n, d in enumerate(DAYS)}
        up = [n for n in range(6) if EARNINGS[n] > 0.3 + 1e-9]
        for place, n in enumerate(up):
            r = w[f"pay-{n}", symbol]
            assert r["post5m_ret"] == pytest.approx(ret[n])
            if place < spec_min(made):
                assert r["baseline_post5m_ret_status"] == "insufficient_history" and r["resid_post5m_ret"] is None
            else:
                assert r["resid_post5m_ret"] == pytest.approx(ret[n] - sum(ret[k] for k in up[:place]) / place)
    assert {r["split"] for r in wide} == {"validation", "unassigned"}


def spec_min(made) -> int:
    return made[-1].baseline_min


def test_report(made):
    *_, wide, windows, spec = made
    t = report(wide, windows, spec)
    q = {(r["event_family"], r["symbol"]): r for r in rows(t["quality"])}
    assert q["UNEMPLOYMENT_RATE", "AAA"]["usable_events"] == 6 and q["UNEMPLOYMENT_RATE", "AAA"]["valid_surprise"] == 5 and q["CPI_MOM", "BBB"]["ambiguous_timestamp_exclusions"] == 2
    assert t["correlation"].where("n >= 3").count() == t["correlation"].where(F.col("pearson").isNotNull()).count() == 2  # the earnings of both symbols have three
    assert t["bins"].where("skipped_reason is null").count() == 0 and t["distribution"].count() > 0 and t["by_sign"].count() > 0 and t["baseline"].count() > 0
