import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import UTC, rows
from tidemark.functions import retry
from tidemark.plans.event_study import label_frame
from tidemark.sources import feeds
from tidemark.streaming import incremental

HEAD = ",".join(feeds.CALENDAR_COLUMNS)
GOOD = "7,1,CPI  m/m,US,USD,HIGH,2025.09.11 15:30:00,2025.08.01,PERCENT,NONE,0.4,0.3,0.2,,1,BROKER"


def test_calendar_csv(spark, tmp_path):
    f = tmp_path / "c.csv"
    f.write_text("\n".join([HEAD, GOOD, "short,row", GOOD + ",extra", "8,2,Nonfarm Payrolls,US,USD,HIGH,2025.09.05 15:30:00,,JOB,THOUSANDS,22,,,,,", "9,3,Unknown Thing,US,USD,LOW,2025.09.05 15:30:00,,,,,,,,,", "10,3,CPI m/m,US,USD,LOW,bad,,,,,,,,,"]) + "\n")
    got = rows(feeds.read_calendar_csv(spark, str(f)), "pos")
    assert [r["value_id"] for r in got] == ["7", "8", "9", "10"] and got[1]["actual_value"] == "22" and got[1]["forecast_value"] is None and got[1]["source_timezone"] == "UNKNOWN"
    e = rows(feeds.normalised_calendar(feeds.read_calendar_csv(spark, str(f)), label_frame(spark), None), "event_id")
    assert [(r["event_family"], r["actual"], r["actual_unit"], r["timestamp_quality"], r["reference_period"]) for r in e] == [("CPI_MOM", 0.4, "PERCENT", "UNRESOLVED", dt.date(2025, 8, 1)), ("NFP", 22.0, "THOUSANDS", "UNRESOLVED", dt.date(2025, 8, 1))]
    z = rows(feeds.normalised_calendar(feeds.read_calendar_csv(spark, str(f)), label_frame(spark), "Europe/Helsinki").select(F.unix_seconds("release_timestamp_utc").alias("s"), "timestamp_quality"), "s")
    assert z[1]["s"] == int(dt.datetime(2025, 9, 11, 12, 30, tzinfo=UTC).timestamp()) and z[1]["timestamp_quality"] == "CONFIRMED"
    (tmp_path / "old.csv").write_text("event_id,event_name,country_code,currency_code,importance,event_time,actual_value,forecast_value,prev_value,revised_prev_value\n1,CPI m/m,US,USD,HIGH,2025.09.11 15:30:00,0.4,,,\n")
    assert rows(feeds.read_calendar_csv(spark, str(tmp_path / "old.csv")))[0]["value_id"] == "legacy:1:2025.09.11 15:30:00"
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        feeds.read_calendar_csv(spark, str(tmp_path / "bad.csv"))


def test_window_log(spark, tmp_path):
    line = lambda **k: ",".join(str(v) for v in ({"a": "2025.09.01", "b": "2025.10.01", "c": "US", "u": "USD", "v": "5", "s": "OK", "n": "3", "t": "1", "l": "x", "d": "ab"} | k).values())
    f = tmp_path / "log.csv"
    f.write_text("\n".join([line(n=1), line(n=2, s="ok"), line(d=""), line(v="4"), line(c="DE"), line(n="x"), "too,short", line(a="2025.10.01", s="FAILED", d="")]) + "\n")
    got = rows(feeds.read_window_log(spark, str(f), "US", "USD"), "window_start")
    assert [(r["window_start"], r["status"], r["row_count"]) for r in got] == [("2025.09.01", "OK", 2), ("2025.10.01", "FAILED", 3)]


def test_official_series(spark, tmp_path):
    f = tmp_path / "s.json"
    f.write_text(json.dumps({"series_id": "CPIAUCSL", "retrieved_at": "2025-09-12T00:00:00Z", "observations": [{"date": "2025-08-01", "value": "1.5", "realtime_start": "2025-09-11"}, {"date": "2025-07-01", "value": "."}, {"date": "oops", "value": "1"}]}))
    got = rows(feeds.official_observations(spark, str(f)), "date")
    assert [(r["date"], r["value"]) for r in got] == [(dt.date(2025, 7, 1), None), (dt.date(2025, 8, 1), 1.5)]
    b = rows(feeds.periodic_observations(spark.createDataFrame([("2025", "M03", "1"), ("2025", "Q02", "-"), ("x", "M01", "1"), ("2025", "M13", "1")], "year string, period string, value string")), "date")
    assert [(r["date"], r["value"]) for r in b] == [(dt.date(2025, 3, 1), 1.0), (dt.date(2025, 4, 1), None)]
    assert feeds.year_windows(2010, 2025, 10) == [(2010, 2019), (2020, 2025)]


def test_bar_pages(spark):
    lo, hi = dt.datetime(2025, 9, 11, tzinfo=UTC), dt.datetime(2025, 9, 12, tzinfo=UTC)
    bar = {"t": "2025-09-11T12:30:00Z", "o": 1, "h": 2, "l": 1, "c": 1.5, "v": 10}
    pages = [{"bars": {"QQQ": [bar, bar | {"t": "2025-09-11T12:30:15Z"}, bar | {"t": "2025-09-11T12:30:00"}, bar | {"c": None}, bar | {"t": "2025-09-13T12:30:00Z"}]}}, {"bars": {"SPY": [bar]}}, {"bars": None}, {"message": "no"}]
    df = spark.createDataFrame([(json.dumps(p),) for p in pages] + [("not json",)], "json string")
    got = sorted(str(r["fault"]) for r in rows(feeds.keyed_bars(df, "QQQ", lo, hi)))
    assert got == sorted(["None", "off_grid", "naive_timestamp", "missing_field", "outside_window", "other_symbol", "no_bars_field", "not_json"])
    sound = feeds.keyed_bars(df.limit(1), "QQQ", lo, hi)
    assert feeds.require_sound(sound.where("fault is null")).count() == 1
    with pytest.raises(Exception, match="bar feed"):
        feeds.require_sound(sound).collect()
    listed = spark.createDataFrame([(json.dumps({"status": "OK", "results": [{"t": 1757593800000, "c": 1}, {"c": 2}, {"t": "2025-09-11T12:30:00", "c": 3}]}),), (json.dumps({"status": "ERROR"}),), (json.dumps({"results": []}),)], "json string")
    assert sorted(str(r["fault"]) for r in rows(feeds.listed_bars(listed, "QQQ"))) == ["None", "naive_timestamp", "no_status", "status"]


def test_paging_and_retries():
    pages = {None: ("a", "1"), "1": ("b", None)}
    assert feeds.fetched(lambda t: pages[t]) == ["a", "b"]
    with pytest.raises(RuntimeError):
        feeds.fetched(lambda t: ("x", "same"))
    answers, waits = [(429, None), (503, None), (200, "ok")], []
    assert retry.retried(lambda: answers.pop(0), sleep=waits.append, rng=random.Random(1)) == "ok" and len(waits) == 2 and waits[1] > 0.9
    with pytest.raises(retry.Permanent):
        retry.retried(lambda: (404, None))


def test_stream_upsert(spark, tmp_path):
    schema = "symbol string, year int, ts long, v double, at int"
    src = tmp_path / "in"
    put = lambda n, data: spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{src}/b{n}")
    seen = []
    run = lambda: incremental.stream_upsert(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(src)), f"{tmp_path}/out", f"{tmp_path}/cp", ["symbol", "ts"], ["symbol", "year"], ["at"], lambda b, n: seen.append(n)).awaitTermination()
    put(0, [("Q", 2024, 1, 1.0, 1), ("Q", 2024, 1, 2.0, 2), ("Q", 2023, 9, 5.0, 1)])
    run()
    put(1, [("Q", 2024, 1, 3.0, 1), ("Q", 2024, 2, 4.0, 1)])
    run()
    got = [(r["year"], r["ts"], r["v"]) for r in rows(spark.read.parquet(f"{tmp_path}/out"), "ts")]
    assert got == [(2024, 1, 3.0), (2024, 2, 4.0), (2023, 9, 5.0)] and seen == [0, 1]


def test_chunks_to_fetch(spark):
    d = dt.date
    chunks = spark.createDataFrame([("k", d(2024, 1, 1), d(2024, 1, 31)), ("k", d(2024, 2, 1), d(2024, 2, 29)), ("k", d(2024, 3, 1), d(2024, 3, 10))], "key string, start date, end date")
    m = spark.createDataFrame([("k", d(2024, 1, 1), d(2024, 1, 31), "complete"), ("k", d(2024, 2, 1), d(2024, 2, 29), "failed"), ("k", d(2024, 3, 1), d(2024, 3, 10), "complete")], "key string, start date, end date, status string")
    got = [r["start"] for r in rows(incremental.to_fetch(chunks, m, d(2024, 3, 12), 3), "start")]
    assert got == [d(2024, 2, 1), d(2024, 3, 1)]
    s = spark.createDataFrame([(5, False, 0, False, None), (5, True, 0, False, None), (0, False, 0, False, None), (5, False, 2, False, None), (5, False, 0, True, None), (5, False, 0, False, "x")], "n int, h boolean, g int, p boolean, e string")
    got = [r[0] for r in s.select(incremental.chunk_status(*[F.col(c) for c in "nhgpe"])).collect()]
    assert got == ["complete", "failed", "empty", "complete_with_known_gaps", "provisional", "failed"]
