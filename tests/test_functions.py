import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, numbers, times

from helpers import UTC


@pytest.mark.parametrize(
    "text,value,unit",
    [
        ("0.3%", 0.3, "PERCENT"), (" -0.2% ", -0.2, "PERCENT"), ("22K", 22.0, "THOUSANDS"), ("1.2M", 1200.0, "THOUSANDS"), ("2B", 2e6, "THOUSANDS"), ("1,234.5", 1234.5, "LEVEL"),
        ("1.5K%", 1.5, "PERCENT"), ("", None, "UNKNOWN"), ("—", None, "UNKNOWN"), ("abc", None, "UNKNOWN"), (None, None, "UNKNOWN"),
    ],
)
def test_parse_value(spark, text, value, unit):
    r = spark.createDataFrame([(text,)], "t string").select(numbers.parse_value(F.col("t")).alias("p")).first().p
    assert (r.value, r.unit) == (pytest.approx(value) if value is not None else None, unit)


@pytest.mark.parametrize(
    "shown,official,status",
    [(0.4, 0.4, "EXACT_MATCH"), (0.4, 0.3825, "ROUNDING_MATCH"), (0.3, 0.346, "ROUNDING_MATCH"), (0.3, 0.35, "VALUE_MISMATCH"), (0.4, 0.348, "VALUE_MISMATCH"), (None, 0.3, None)],
)
def test_compare_displayed(spark, shown, official, status):
    df = spark.createDataFrame([(shown, official)], "a double, b double")
    assert df.select(numbers.compare_displayed(F.col("a"), F.col("b"))).first()[0] == status


def test_time_of_day(spark):
    texts = ["8:30am", "12:00am", "12:15pm", "14:00", "All Day", "Tentative", "25:00", None, "1:75pm"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", times.time_of_day(F.col("t")).alias("m"))
    assert [r.m for r in df.orderBy("k").collect()] == [510, 0, 735, 840, None, None, None, None, None]


def test_ambiguous_local_time_takes_the_nearest(spark):
    wall, refs = dt.datetime(2025, 10, 26, 3, 30), [dt.datetime(2025, 10, 26, 0, 30, tzinfo=UTC), dt.datetime(2025, 10, 26, 1, 30, tzinfo=UTC)]
    df = spark.createDataFrame([(wall, r) for r in refs], "w timestamp_ntz, r timestamp")
    got = df.select("r", times.local_to_utc_near(F.col("w"), "Europe/Helsinki", F.col("r")).alias("x")).select("r", F.unix_seconds("x.instant").alias("s"), "x.ambiguous").collect()
    assert all(g.s == int(g.r.replace(tzinfo=UTC).timestamp()) if g.r.tzinfo else True for g in got)
    assert sorted(g.s for g in got) == [int(r.timestamp()) for r in refs] and all(g.ambiguous for g in got)


def test_skipped_hour_is_flagged(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 3, 30, 3, 30), dt.datetime(2025, 3, 30, 1, 0, tzinfo=UTC))], "w timestamp_ntz, r timestamp")
    x = df.select(times.local_to_utc_near(F.col("w"), "Europe/Helsinki", F.col("r")).alias("x")).first().x
    assert x.nonexistent and not x.ambiguous


def test_session_clock(spark):
    from helpers import ny

    day = dt.date(2024, 3, 13)
    at = [(ny(day, 3, 59), "CLOSED"), (ny(day, 4), "PREMARKET"), (ny(day, 9, 30), "REGULAR"), (ny(day, 15, 59), "REGULAR"), (ny(day, 16), "AFTER_HOURS"), (ny(day, 20), "CLOSED"), (ny(dt.date(2024, 3, 16), 11), "CLOSED")]
    df = spark.createDataFrame(at, "t timestamp, want string").select("want", times.clock_session(F.col("t")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_chunks(spark):
    got = [(r.start, r.end) for r in times.chunks(spark, dt.date(2024, 1, 20), dt.date(2024, 3, 5)).collect()]
    d = dt.date
    assert got == [(d(2024, 1, 20), d(2024, 1, 31)), (d(2024, 2, 1), d(2024, 2, 29)), (d(2024, 3, 1), d(2024, 3, 5))]
    assert times.timeframe_minutes("5min") == 5 and times.timeframe_minutes("1h") == 60
    for bad in ("1day", "0min", "x"):
        with pytest.raises(ValueError):
            times.timeframe_minutes(bad)


def test_fnv_vectors():
    assert hashing.fnv1a(b"") & 0xFFFFFFFFFFFFFFFF == 0xCBF29CE484222325
    assert hashing.fnv1a(b"a") & 0xFFFFFFFFFFFFFFFF == 0xAF63DC4C8601EC8C


def test_window_digest_ignores_order_and_takes_the_last(spark):
    rows = [("w", 1, "a", 1), ("w", 2, "b", 2), ("w", 1, "c", 3)]
    schema = "w string, id int, x string, pos int"
    a = hashing.window_digest(spark.createDataFrame(rows, schema), ["w"], "id", ["id", "x"], "pos").first()
    b = hashing.window_digest(spark.createDataFrame(rows[::-1], schema).repartition(3), ["w"], "id", ["id", "x"], "pos").first()
    want = (hashing.fnv1a(b"1\x1fc") ^ hashing.fnv1a(b"2\x1fb")) & 0xFFFFFFFFFFFFFFFF
    assert a == b and a.digest == f"{want:016x}" and a.n == 2


def test_content_hash_ignores_order_partitions_and_column_order(spark):
    df = spark.createDataFrame([(k, k / 7, None if k % 3 else "x", dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(k)) for k in range(50)], "k long, v double, s string, t timestamp")
    h = hashing.content_hash(df, ["k"])
    assert h == hashing.content_hash(df.repartition(5).select("t", "s", "v", "k"), ["k"])
    assert h != hashing.content_hash(df.withColumn("v", F.when(F.col("k") == 3, F.col("v") + 1e-12).otherwise(F.col("v"))), ["k"])


def test_content_hash_of_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(hashing, "LEAF_ROWS", 7)
    monkeypatch.setattr(hashing, "FAN", 4)
    rows = [(k, None if k % 5 == 0 else k / 3, float("nan") if k % 7 == 0 else -0.0, ["x", None], f"t{k % 9}" if k % 4 else None, dt.datetime(2024, 1, 1, k % 24), k % 2 == 0 if k % 3 else None, dt.date(2024, 1, 1 + k % 28)) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, v double, z double, a array<string>, s string, t timestamp, b boolean, d date")
    one = hashing.content_hash(df, ["k"])
    assert {hashing.content_hash(df.repartition(n).select(*sorted(df.columns, reverse=True)), ["k"]) for n in (1, 3, 8)} == {one}
    assert hashing.content_hash(df.withColumn("k", F.col("k").cast("double")), ["k"]) == one and hashing.content_hash(df.withColumn("z", F.when(F.isnan("z"), None).otherwise(0.0)), ["k"]) == one
    for c, other in (("v", F.when(F.col("k") == 7, 1e-300).otherwise(F.col("v"))), ("s", F.coalesce("s", F.lit(""))), ("a", F.array(F.lit("x"), F.lit(""))), ("t", F.col("t").cast("timestamp_ntz")), ("b", F.coalesce("b", F.lit(False))), ("k", F.when(F.col("k") == 9, 1 << 60).otherwise(F.col("k")))):
        assert hashing.content_hash(df.withColumn(c, other), ["k"]) != one, c
    assert hashing.content_hash(df.limit(0), ["k"]) != one


def test_bar_hash_equals_an_independent_one(spark):
    """The same bytes made with struct and hashlib, a value at a time."""
    import collections
    import hashlib
    import json
    import random
    import struct

    rng = random.Random(4)
    columns = ["open", "high", "low", "close", "volume"]
    data = [(s, d * 86_400_000_000 + m * 60_000_000, *(rng.choice([None, float("nan"), -0.0, rng.gauss(0, 1), 5.0]) for _ in columns)) for s in ("A", "B") for d in (-1, 0, 365, 366, 800) for m in range(5)]
    rng.shuffle(data)
    days = collections.defaultdict(list)
    for s, us, *values in data:
        days[s, us // 86_400_000_000].append((us, *(None if v is None or v != v else v + 0.0 for v in values)))
    nan = struct.pack("<Q", 0x7FF8000000000000)
    want, sha = {}, lambda b: hashlib.sha256(b).digest()
    for s in ("A", "B"):
        years = collections.defaultdict(list)
        for (who, day), bars in sorted(days.items()):
            if who == s:
                bars.sort()
                raw = b"".join(json.dumps([c, "f", len(bars)]).encode() + b"\0" + b"".join(nan if b[k] is None else struct.pack("<d", b[k]) for b in bars) for k, c in enumerate(["us", *columns]))
                years[day // 366].append(f"{day}:{sha(raw.replace(b'[\"us\"', b'[\"bar_us\"')).hex().upper()}")
        want[s] = sha("\n".join(f"{y}:{sha(chr(10).join(lines).encode()).hex().upper()}" for y, lines in sorted(years.items())).encode()).hex()
    # microseconds of these days are below 2^53, so they are packed as floats like any whole number
    df = spark.createDataFrame(data, "symbol string, bar_us long, open double, high double, low double, close double, volume double")
    for n in (1, 4):
        assert {r["symbol"]: (r["content_sha256"], r["rows"]) for r in hashing.bar_hash(df.repartition(n), ["symbol"]).collect()} == {s: (h, 25) for s, h in want.items()}


def test_canonical():
    assert hashing.canonical(0.1) == "0.10000000000000001" and hashing.canonical(3.0) == 3 and hashing.canonical(float("nan")) is None
    assert hashing.canonical(dt.datetime(2024, 1, 1)).startswith("naive:")
