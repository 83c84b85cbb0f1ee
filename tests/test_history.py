import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import diagnostics, history

from helpers import rows


def z(spark, values, usable=None, min_history=3, ts=None):
    data = [("CPI", (ts or list(range(len(values))))[k] * 10, v, True if usable is None else usable[k]) for k, v in enumerate(values)]
    df = spark.createDataFrame(data, "fam string, t long, v double, ok boolean")
    return rows(history.causal_zscore(df.repartition(3), ["fam"], "t", "v", F.col("ok"), min_history=min_history), "t")


def test_causal(spark):
    v = [0.1, -0.2, 0.3, 0.0, 0.5, -0.1]
    r = z(spark, v)
    assert [x["surprise_std_status"] for x in r] == ["insufficient_history"] * 3 + ["ok"] * 3
    for k in range(3, 6):
        assert r[k]["surprise_std"] == pytest.approx((v[k] - statistics.mean(v[:k])) / statistics.stdev(v[:k]))
        assert r[k]["surprise_std_n_history"] == k
    assert z(spark, v[:5] + [99.0])[:5] == r[:5]


def test_flat_history_and_ties(spark):
    r = z(spark, [0.0, 0.0, 0.0, 0.25])
    assert r[3]["surprise_std_status"] == "zero_historical_dispersion" and r[3]["surprise_std"] is None
    r = z(spark, [0.1, 0.2, 0.3, 0.4, 0.5], ts=[1, 2, 3, 4, 4])
    assert [x["surprise_std_n_history"] for x in r][-2:] == [3, 3]


def test_status_of_missing_and_excluded(spark):
    r = z(spark, [0.1, None, 0.3, 0.2], usable=[True, True, False, True], min_history=2)
    assert [x["surprise_std_status"] for x in r] == ["insufficient_history", "missing_value", "event_excluded", "insufficient_history"]
    assert r[3]["surprise_std_n_history"] == 1


def test_surprise(spark):
    df = spark.createDataFrame([(0.3, 0.1), (None, 0.1), (0.2, None), (150.0, 100.0), (1.0, -2.0)], "actual double, forecast double")
    r = rows(history.with_surprise(df, relative=F.col("forecast") != 0.1))
    assert [x["surprise_raw"] for x in r] == [pytest.approx(0.2), None, None, 50.0, 3.0]
    assert [x["surprise_relative_status"] for x in r] == ["not_meaningful_for_family", "missing_actual", "missing_forecast", "ok", "forecast_not_positive"]
    assert r[3]["surprise_relative"] == pytest.approx(0.5)


def test_baseline_keeps_expectations_of_unobserved(spark):
    data = [("s", k, 1, 0.01 * k, k != 9) for k in range(12)]
    df = spark.createDataFrame(data, "fam string, t long, sg int, ret double, ok boolean")
    r = rows(history.expanding_baseline(df, ["fam"], "t", "sg", [("ret", "ret", F.col("ok"))]), "t")
    assert [x["baseline_ret_status"] for x in r] == ["insufficient_history"] * 8 + ["ok", "no_observed_response", "ok", "ok"]
    assert r[9]["expected_ret"] == pytest.approx(0.04) and r[9]["resid_ret"] is None
    assert r[10]["baseline_ret_n_history"] == 9


def test_tie_safe_bins(spark):
    data = [("a", 0.0)] * 15 + [("a", float(k)) for k in range(1, 7)] + [("b", 0.0)] * 10 + [("b", 0.25), ("b", -0.25)] + [("c", 1.0)] * 4
    r = rows(diagnostics.tie_safe_bins(spark.createDataFrame(data, "g string, v double"), ["g"], "v").select("g", "v", "bin", "actual_bins").distinct(), "g", "v")
    assert [x["bin"] for x in r if x["g"] == "a"] == [1, 1, 2, 2, 3, 4, 5]
    assert [x["bin"] for x in r if x["g"] == "b"] == [1, 2, 3] and [x["bin"] for x in r if x["g"] == "c"] == [None]


def test_correlation_of_constants_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, float(k)) for k in range(4)] + [("b", float(k), float(-k)) for k in range(4)], "g string, x double, y double")
    r = {x["g"]: x for x in rows(diagnostics.correlations(df, ["g"], "x", "y"))}
    assert r["a"]["pearson"] is None and r["b"]["pearson"] == pytest.approx(-1) and r["b"]["spearman"] == pytest.approx(-1)
