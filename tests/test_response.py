import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from helpers import BAR, UTC, rows
from tidemark.operators.response import asof_backward, market_response

T = dt.datetime(2025, 9, 5, 12, 30, tzinfo=UTC)


def bars(close=lambda i: 100 + 0.5 * i, volume=lambda i: 1000.0 + i, drop=()):
    c = lambda i: float(close(i))
    return [("QQQ", T + dt.timedelta(minutes=i), c(i), c(i) + 0.1, c(i) - 0.1, c(i), float(volume(i))) for i in range(-45, 71) if i not in drop]


def run(spark, t=T, **more):
    rel = spark.createDataFrame([("r", "QQQ", t)], "release_id string, symbol string, release_ts timestamp")
    return rows(market_response(rel, spark.createDataFrame(bars(**more), BAR)))[0]


def test_returns(spark):
    r = run(spark)
    assert (r["baseline_price"], r["bars_found"], r["market_window_status"]) == (99.5, 90, "OK")
    for k in (1, 5, 15, 30, 60):
        assert r[f"ret_post_{k}m"] == pytest.approx((100 + 0.5 * (k - 1)) / 99.5 - 1) and r[f"direction_{k}m"] == 1
    r = run(spark, close=lambda i: 100 + i)
    assert r["ret_pre_5m"] == pytest.approx(99 / 94 - 1) and r["ret_pre_30m"] == pytest.approx(99 / 69 - 1)
    assert r["max_up_5m"] == pytest.approx(104.1 / 99 - 1) and r["max_down_5m"] == pytest.approx(99.9 / 99 - 1)


def test_volatility_and_volume(spark):
    r = run(spark, close=lambda i: 100 * 1.001**i, volume=lambda i: 10 if i < 0 else 30)
    assert r["realized_vol_post_30m"] == pytest.approx(math.sqrt(30) * math.log(1.001)) and r["realized_vol_pre_30m"] == pytest.approx(math.sqrt(30) * math.log(1.001))
    assert r["realized_vol_post_60m"] == pytest.approx(math.sqrt(60) * math.log(1.001))
    assert (r["volume_pre_30m"], r["volume_post_30m"], r["volume_post_60m"], r["volume_ratio_30m"]) == (300, 900, 1800, pytest.approx(3))
    assert run(spark, volume=lambda i: 0 if i < 0 else 30)["volume_ratio_30m_status"] == "PRE_VOLUME_ZERO"
    assert run(spark, drop={-10})["volume_ratio_30m_status"] == "PRE_VOLUME_MISSING"
    assert run(spark, drop={7})["volume_ratio_30m_status"] == "POST_VOLUME_MISSING"


def test_baseline_looks_back(spark):
    r = run(spark, drop={-1, -2})
    assert r["baseline_timestamp_utc"].replace(tzinfo=UTC) == T - dt.timedelta(minutes=3)
    assert r["realized_vol_post_30m"] is None and (r["market_window_status"], r["missing_pre_bars"]) == ("INSUFFICIENT_PRE_WINDOW", 2)
    assert run(spark, drop=set(range(-8, 0)))["market_window_status"] == "NO_BASELINE_BAR"
    assert run(spark, drop={20})["market_window_status"] == "INSUFFICIENT_POST_WINDOW"


def test_no_time_and_no_data(spark):
    assert run(spark, t=None)["market_window_status"] == "NO_TRUSTED_EVENT_TIMESTAMP"
    assert run(spark, t=T + dt.timedelta(days=30))["market_window_status"] == "MISSING_MARKET_DATA"


def test_unaligned_release(spark):
    r = run(spark, t=T + dt.timedelta(seconds=12))
    assert r["timestamp_minute_aligned"] is False and r["realized_vol_post_30m"] is None
    assert r["ret_post_1m"] == pytest.approx(100.5 / 99.5 - 1)


def test_future_does_not_leak(spark):
    a = run(spark)
    b = run(spark, close=lambda i: 100 + 0.5 * i if i < 5 else 1e6)
    assert all(a[k] == b[k] for k in ("baseline_price", "ret_pre_5m", "ret_post_1m", "ret_post_5m", "max_up_5m", "realized_vol_pre_30m"))


def test_asof_excludes_equal_and_keeps_unmatched(spark):
    left = spark.createDataFrame([("a", 100, None), ("a", 10_000, "x")], "k string, t long, extra string")
    right = spark.createDataFrame([("a", 100, 1.0), ("a", 90, 2.0), ("a", 80, 3.0)], "k string, u long, v double")
    r = rows(asof_backward(left, right, ["k"], "t", "u", 3, 10, ["v"]), "t")
    assert [(x["u"], x["v"], x["extra"]) for x in r] == [(90, 2.0, None), (None, None, "x")]
    assert asof_backward(left.where(F.lit(False)), right, ["k"], "t", "u", 3, 10, ["v"]).count() == 0


def test_releases_of_one_place_are_measured_once(spark):
    rel = spark.createDataFrame([(f"r{i}", "QQQ", T + dt.timedelta(seconds=i % 60)) for i in range(300)] + [("n", None, T), ("u", "QQQ", None)], "release_id string, symbol string, release_ts timestamp")
    out = market_response(rel, spark.createDataFrame(bars(), BAR))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [symbol" in plan and "low" in plan.split("Aggregate [symbol")[1].split("]")[0]
    got = {r["release_id"]: r for r in rows(out)}
    assert len(got) == 302 and all(got[f"r{i}"]["release_ts"].second == i % 60 for i in range(300))
    alone = {s: run(spark, t=T + dt.timedelta(seconds=s)) for s in (0, 12)}
    for i in range(300):
        a, b = dict(got[f"r{i}"]), dict(alone[12 if i % 60 else 0])
        assert {k: v for k, v in a.items() if k not in ("release_id", "release_ts")} == {k: v for k, v in b.items() if k not in ("release_id", "release_ts")}
    assert got["n"]["market_window_status"] == "MISSING_MARKET_DATA" and got["u"]["market_window_status"] == "NO_TRUSTED_EVENT_TIMESTAMP"
