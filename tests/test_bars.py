import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import ny, rows
from tidemark.operators import bars, compare
from tidemark.plans import catalogue
from tidemark.sources.sessions import session_frame

MIN = 60_000_000
DAY = dt.date(2020, 1, 2)


def us(t):
    return int(t.timestamp()) * 1_000_000


def session_bars(spark, keep=lambda k: True, n=390, price=lambda k: 1.0, volume=1.0, extra=()):
    open_us = us(ny(DAY, 9, 30))
    data = [("QQQ", open_us + k * MIN, price(k), price(k), price(k), price(k), volume) for k in range(n) if keep(k)] + [("QQQ", t, 1.0, 1.0, 1.0, 1.0, volume) for t in extra]
    return spark.createDataFrame(data, "symbol string, bar_us long, open double, high double, low double, close double, volume double")


def coverage(spark, b, **more):
    s = session_frame(spark, DAY, DAY).select(F.col("ny_date").alias("session"), F.unix_micros("open").alias("open_us"), F.unix_micros("close").alias("close_us"))
    return rows(bars.slot_coverage(b, s, ["symbol"], MIN, **more))[0]


def test_slot_coverage(spark):
    r = coverage(spark, session_bars(spark))
    assert (r["verdict"], r["covered"], r["n_slots"], r["missing_open_edge"], r["missing_close_edge"]) == ("complete", 390, 390, False, False)
    assert coverage(spark, session_bars(spark, lambda k: k == 200))["verdict"] == "incomplete"
    assert coverage(spark, session_bars(spark, lambda k: k > 0))["missing_open_edge"] and coverage(spark, session_bars(spark, lambda k: k < 389))["missing_close_edge"]
    assert coverage(spark, session_bars(spark, lambda k: False, extra=[us(ny(DAY, 4))]))["verdict"] == "missing"


def test_as_of_judges_elapsed_minutes_only(spark):
    now = us(ny(DAY, 10, 30))
    r = coverage(spark, session_bars(spark, n=60), as_of_us=now)
    assert (r["verdict"], r["covered"], r["n_slots"], r["missing_close_edge"]) == ("provisional", 60, 60, False)


def test_integrity(spark):
    t = us(ny(DAY, 9, 30))
    nan, inf = float("nan"), float("inf")
    data = [
        ("a", t, 1.0, 1.0, 1.0, 1.0, 1.0), ("a", t, 1.0, 1.0, 1.0, 1.0, 1.0), ("a", t + MIN, 1.0, 0.5, 1.0, 1.0, 1.0), ("a", t + 2 * MIN, None, 1.0, 1.0, 1.0, 1.0), ("a", t + 3 * MIN, nan, 1.0, 1.0, 1.0, 1.0), ("a", t + 4 * MIN, inf, 1.0, 1.0, 1.0, 1.0),
        ("a", t + 5 * MIN, 1.0, 1.0, -1.0, 1.0, 1.0), ("a", t + 6 * MIN, 1.0, 1.0, 1.0, 1.0, -1.0), ("a", t + 7 * MIN + 15_000_000, 1.0, 1.0, 1.0, 1.0, 50.0),
    ]
    df = spark.createDataFrame(data, "symbol string, bar_us long, open double, high double, low double, close double, volume double")
    r = rows(bars.integrity(df, ["symbol"]))[0]
    assert {k: v for k, v in r.items() if k != "symbol"} == {
        "total_rows": 9, "duplicate_timestamp_count": 1, "misaligned_timestamp_count": 1, "null_or_nonfinite_count": 3, "invalid_ohlc_count": 1, "non_positive_price_count": 1, "negative_volume_count": 1, "suspicious_volume_count": 1,
    }


def test_provenance(spark):
    b = session_bars(spark).withColumns({"source": F.lit("ALPACA"), "feed": F.when(F.col("bar_us") % 7 == 0, "iex").otherwise("sip")})
    with pytest.raises(ValueError, match="feed_faults"):
        bars.require_provenance(b, {"source": "ALPACA", "feed": "sip"})
    bars.require_provenance(b.withColumn("feed", F.lit("sip")), {"source": "ALPACA", "feed": "sip"})


def test_compare(spark):
    a = session_bars(spark, extra=[us(ny(DAY, 8)), us(ny(DAY, 8, 1))])
    b = session_bars(spark, lambda k: k % 2 == 0)
    p = compare.with_regular(compare.matched(a, b), session_frame(spark, DAY, DAY))
    c = rows(compare.coverage(p))[0]
    assert (c["n_both"], c["n_only_a"], c["n_only_b"]) == (195, 197, 0)
    assert p.where("in_a and not in_b and regular").count() == 195 and p.where("in_a and not in_b and not regular").count() == 2
    x, y = session_bars(spark, n=10, price=lambda k: 1.0 + k % 3), session_bars(spark, lambda k: k != 5, n=10, price=lambda k: 1.0 + k % 3)
    r = compare.return_pairs(compare.matched(x, y), MIN)
    assert r.count() == 7 and rows(compare.return_correlation(r))[0]["corr"] == pytest.approx(1.0)
    assert rows(compare.return_correlation(compare.return_pairs(compare.matched(session_bars(spark, n=10), session_bars(spark, n=10)), MIN)))[0]["corr"] is None


def test_sides_must_be_comparable():
    side = lambda **k: compare.Side(**({"label": "a", "source": "A", "feed": "sip", "feed_scope": "consolidated", "adjustment": "raw", "timeframe": "1min"} | k))
    assert compare.check_compatible(side(), side(source="B")) and not compare.check_compatible(side(), side(feed="iex", feed_scope="single_venue"))
    for other in (side(), side(source="B", adjustment="split"), side(source="B", timeframe="5min")):
        with pytest.raises(compare.Incompatible):
            compare.check_compatible(side(), other)


def test_required_offsets(spark):
    t = us(ny(DAY, 10))
    rel = spark.createDataFrame([("r", "QQQ", t), ("s", "QQQ", t + 15_000_000)], "id string, symbol string, t_us long")
    got = {r["id"]: r["missing"] for r in rows(bars.missing_offsets(rel, session_bars(spark, lambda k: k != 32), ["id"], [-1, 0, 1, 2, 5], MIN))}
    assert got == {"r": [2], "s": [1]}


def test_prices_of_zero_and_flat_columns_as_sql_has_them(spark, tmp_path):
    """Logarithms of 0 are infinite and correlations with them, or of what does not vary, NaN: not left out, as Spark's nulls would be."""
    duckdb = pytest.importorskip("duckdb")
    rng, start, events = random.Random(11), dt.datetime(2024, 1, 1), []
    for hour in range(8 * 24):
        for symbol in ("walk", "zero", "below", "flat"):
            for user in (0, 1):
                # user 1 has the close of each hour; hour 95 is a day's last
                price, k = round(rng.uniform(20, 90), 2), rng.randrange(90)
                if user == 1 and hour in (70, 71, 95):
                    price = {"zero": 0.0, "below": -3.0}.get(symbol, price)
                if symbol == "flat":
                    price, k = 5.0, 7
                events.append((len(events), start + dt.timedelta(hours=hour, minutes=30 * user + rng.randrange(30)), user, symbol, price, f'{{"k": {k}}}'))
    events += [(len(events) + i, start + dt.timedelta(minutes=i), i, "pair", 3.0 + i, f'{{"k": {5 - i}}}') for i in range(2)]
    db = duckdb.connect()
    db.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    db.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", events)
    db.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    shown = {}
    for name, key in {"cross_provider_corr": 1, "rank_corr": 1, "window_returns": 3, "response_features": 1}.items():
        found = catalogue.QUERIES[name](spark, str(tmp_path))
        sql = db.execute("SELECT " + ", ".join(f'"{c}"' for c in found.columns) + f" FROM ({catalogue.ORACLE[name]})").fetchall()
        by_key = lambda rs: {tuple(r)[:key]: tuple(r)[key:] for r in rs}
        a, b = by_key(found.collect()), by_key(sql)
        assert a.keys() == b.keys()
        for k in a:
            assert a[k] == pytest.approx(b[k], abs=2e-6, nan_ok=True), (name, k)
        shown[name] = b
    assert math.isfinite(shown["cross_provider_corr"]["walk",][1]) and all(math.isnan(shown["cross_provider_corr"][s,][1]) for s in ("zero", "below", "flat"))
    assert math.isnan(shown["rank_corr"]["flat",][2]) and shown["rank_corr"]["pair",][2] == -1
    assert all(any(math.inf in r for r in shown[q].values()) for q in ("window_returns", "response_features"))
