import datetime as dt
import itertools
import random

import pytest
from helpers import UTC, rows
from tidemark.operators import reconcile

DAY = dt.date(2025, 9, 11)


def vintage(spark, days_values, release=DAY):
    r = spark.createDataFrame([("CPI", "p", release)], "fam string, period string, released date")
    v = spark.createDataFrame([("CPI", "p", DAY + dt.timedelta(k), x) for k, x in days_values], "fam string, period string, vd date, x double")
    got = rows(reconcile.release_vintage(r, v, ["fam", "period"], "released", "vd", "x", 3))[0]
    return got["vintage_code"], got["vintage_value"]


@pytest.mark.parametrize(
    "given,want",
    [([(0, 0.4), (1, 0.5)], ("OK", 0.4)), ([(2, 0.4)], ("OK", 0.4)), ([(0, 0.4), (0, 0.5)], ("AMBIGUOUS", None)), ([(4, 0.4)], ("LOOKAHEAD_REJECTED", None)), ([(-1, 0.4)], ("PREDATES_RELEASE", None)), ([(-1, 0.4), (9, 0.1)], ("LOOKAHEAD_REJECTED", None)), ([], ("NONE", None)), ([(0, None)], ("NONE", None))],
)
def test_release_vintage(spark, given, want):
    assert vintage(spark, given) == want


def test_components_equal_union_find(spark):
    random.seed(3)
    base = dt.date(2024, 1, 1)
    data = [(k, random.choice("AB"), random.choice([None, base, base.replace(month=2)]), random.choice([None, *(base + dt.timedelta(j) for j in range(0, 40, 3)), base + dt.timedelta(4)])) for k in range(60)]
    df = spark.createDataFrame(data, "row_id long, event_family string, period date, date date")
    got = {r["row_id"]: r["release_no"] for r in rows(reconcile.matched_releases(df))}
    up = {r[0]: r[0] for r in data}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(data, 2):
        same = a[1] == b[1] and (a[2] == b[2] if a[2] and b[2] else bool(a[3] and b[3] and abs((a[3] - b[3]).days) <= 1))
        if same:
            x, y = top(a[0]), top(b[0])
            up[max(x, y)] = min(x, y)
    assert got == {k: top(k) for k in up}


def test_each_status_is_reachable(spark):
    ts = dt.datetime(2025, 9, 11, 12, 30, tzinfo=UTC)
    base = dict(name="MATCH", a_actual=0.4, b_actual=0.4, a_unit="PERCENT", b_unit="PERCENT", a_ts=ts, b_ts=ts, official_value=0.3825, official_unit="PERCENT", vintage_code="OK", semantic_issue=None)
    cases = [
        base, base | {"name": "SEMANTIC_MISMATCH", "semantic_issue": "label"}, base | {"name": "UNIT_MISMATCH", "b_unit": "THOUSANDS"}, base | {"name": "VALUE_CONFLICT", "b_actual": 0.5}, base | {"name": "TIMESTAMP_CONFLICT", "b_ts": ts + dt.timedelta(minutes=5)},
        base | {"name": "VINTAGE_AMBIGUOUS", "vintage_code": "AMBIGUOUS", "official_value": None}, base | {"name": "LOOKAHEAD_REJECTED", "vintage_code": "LOOKAHEAD_REJECTED", "official_value": None}, base | {"name": "OFFICIAL_MISMATCH", "official_value": 0.348},
        base | {"name": "MISSING_SOURCE", "b_actual": None}, base | {"name": "NO_OFFICIAL_VINTAGE", "official_value": None, "vintage_code": "NONE"},
    ]
    schema = "name string, a_actual double, b_actual double, a_unit string, b_unit string, a_ts timestamp, b_ts timestamp, official_value double, official_unit string, vintage_code string, semantic_issue string"
    got = rows(reconcile.reconciled(spark.createDataFrame([tuple(c.values()) for c in cases], schema)))
    assert [g["source_match_status"] for g in got] == [c["name"] for c in cases]
    assert got[0]["release_actual_match_status"] == "ROUNDING_MATCH"


def test_macro_comparison(spark):
    p = dt.date(2025, 8, 1)
    schema = "event_family string, source string, reference_period date, release_timestamp_utc timestamp, actual double, actual_unit string, official_actual double, official_actual_unit string, official_vintage_kind string, official_vintage_date date, position int"
    data = [
        ("CPI", "MQL5", p, None, 0.4, "PERCENT", None, None, None, None, 1), ("CPI", "FF", p, None, 0.3, "PERCENT", None, None, None, None, 2), ("CPI", "FF", p, None, 0.4, "PERCENT", None, None, None, None, 3),
        ("CPI", "FRED", p, None, None, None, 0.38, "PERCENT", "AS_OF", DAY, 4), ("CPI", "FRED", p, None, None, None, 0.9, "PERCENT", "LATEST_REVISED", None, 5),
        ("NFP", "FF", p, None, 22.0, "UNKNOWN", None, None, None, None, 6), ("NFP", "FRED", p, None, None, None, 22.0, "THOUSANDS", "LATEST_REVISED", None, 7),
    ]
    got = {(r["event_family"], r["field"]): r["status"] for r in rows(reconcile.macro_comparison(spark.createDataFrame(data, schema)))}
    assert got == {
        ("CPI", "actual"): "MATCH", ("CPI", f"actual_vs_official_asof:{DAY}"): "ROUNDING_DIFFERENCE", ("CPI", "actual_vs_official_latest_revised"): "MISMATCH", ("NFP", "actual"): "MISSING", ("NFP", "actual_vs_official_asof"): "MISSING",
        ("NFP", "actual_vs_official_latest_revised"): "MISSING",
    }


def test_broker_zone(spark):
    f = lambda data: rows(reconcile.broker_timezone_verdict(spark.createDataFrame(data, "trusted_us long, converted_us long, offset_hours int, zone_changes boolean")))[0]["verdict"]
    m = 60_000_000
    assert f([(m, m, 2, True), (9 * m, 9 * m, 3, True)]) == "MATCH" and f([(m, m, 2, True), (9 * m, 9 * m, 2, True)]) == "UNVERIFIABLE"
    assert f([(m, 61 * m, 2, False), (9 * m, 9 * m, 2, False)]) == "MISMATCH" and f([(m, None, None, None)]) == "UNVERIFIABLE"


def test_prior_periods(spark):
    p0, p1 = dt.date(2025, 7, 1), dt.date(2025, 8, 1)
    r = spark.createDataFrame([("CPI", "B", p1, DAY, 0), ("CPI", "B", p0, dt.date(2025, 8, 12), 0), ("CPI2", "B", p1, DAY, 0)], "event_family string, release_bundle string, period date, release_date date, source_rank int")
    got = {(x["event_family"], x["period"]): x["previous_release_date"] for x in rows(reconcile.prior_release_dates(r))}
    assert got == {("CPI", p1): dt.date(2025, 8, 12), ("CPI", p0): None, ("CPI2", p1): dt.date(2025, 8, 12)}
    x = spark.createDataFrame([("CPI", p1, p0, DAY, dt.date(2025, 8, 12), 0.2, 0.3)], "event_family string, period date, previous_period date, release_date date, previous_release_date date, previous double, revised_previous double")
    v = spark.createDataFrame([("CPI", p0, dt.date(2025, 8, 12), 0.2), ("CPI", p0, DAY, 0.31)], "event_family string, period date, vintage_date date, value double")
    y = rows(reconcile.prior_validation(x, v))[0]
    assert (y["previous_validation_status"], y["revised_previous_validation_status"]) == ("exact_match", "rounding_match") and y["official_prior_period_revision"] == pytest.approx(0.11)


def test_rows_of_a_date_without_periods_are_a_star(spark):
    """200 rows of one family and date, and neighbours: links in proportion to rows, and the same releases as all pairs give."""
    day = dt.date(2023, 5, 10)
    data = [(k, "F", None, day) for k in range(200)] + [(300, "F", dt.date(2023, 4, 1), day + dt.timedelta(1)), (301, "F", None, day + dt.timedelta(2)), (302, "F", None, day + dt.timedelta(4)), (303, "G", None, day), (304, "F", None, None)]
    df = spark.createDataFrame(data, "row_id long, event_family string, period date, date date")
    assert reconcile.compatibility_edges(df).count() < 3 * len(data)
    got = {r["row_id"]: r["release_no"] for r in reconcile.matched_releases(df).collect()}
    assert {got[k] for k in [*range(200), 300, 301]} == {0} and (got[302], got[303], got[304]) == (302, 303, 304)


def test_digits_and_rounding_are_made_once_for_a_row(spark):
    r = spark.range(3).selectExpr(
        "id * 0.25D as a_actual", "id * 0.25D as b_actual", "'PERCENT' as a_unit", "'PERCENT' as b_unit", "timestamp_micros(0) as a_ts", "timestamp_micros(0) as b_ts", "id * 0.249D as official_value", "'PERCENT' as official_unit", "'OK' as vintage_code", "cast(null as string) as semantic_issue"
    )
    out = reconcile.reconciled(r)
    # each reading of a shortest decimal form is such a cast; in status and issues together there were hundreds
    assert out.select("source_match_status", "issues")._jdf.queryExecution().optimizedPlan().toString().count("decimal(38,18)") < 60
    assert [(x["comparison_decimals"], x["release_actual_match_status"]) for x in out.orderBy("a_actual").collect()] == [(1, "EXACT_MATCH"), (2, "ROUNDING_MATCH"), (1, "ROUNDING_MATCH")]


def test_tasks_grow_with_the_vintages(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "TASK_ROWS", 10)
    v = spark.range(200).selectExpr("id % 50 as k", "date_add(date'2024-01-01', cast(id div 50 as int)) as d", "cast(id as double) as x")
    r = spark.range(60).selectExpr("id as k", "date'2024-01-02' as released")
    out = reconcile.release_vintage(r, v, ["k"], "released", "d", "x", 3)
    assert out.rdd.getNumPartitions() == 20
    got = {x["k"]: (x["vintage_code"], x["vintage_value"]) for x in out.collect()}
    assert got == {k: ("OK", 50.0 + k) if k < 50 else ("NONE", None) for k in range(60)}
