"""The paged data source over recorded stores, batch and stream."""

import datetime as dt
import json

import pytest
from helpers import UTC, rows

from tidemark.sources import paged

DAY = dt.timedelta(1)


def put(root, symbol, month, token, bars, following=None, **more):
    d = root / f"symbol={symbol}" / f"month={month}" / f"token={token}"
    d.mkdir(parents=True, exist_ok=True)
    text = {"bars": {symbol: bars}, "next_page_token": following} | more
    (d / "part-0.txt").write_text(json.dumps(text))


def bar(day, minute, price=1.5, **more):
    return {"t": f"{day}T14:{minute:02}:00Z", "o": price, "h": price + 1, "l": price - 1, "c": price, "v": 10} | more


@pytest.fixture
def store(tmp_path):
    for symbol in ("AAA", "BBB"):
        for month in (1, 2):
            day = f"2024-0{month}-05"
            put(tmp_path, symbol, day[:7], "first", [bar(day, 0), bar(day, 1)], "t2")
            put(tmp_path, symbol, day[:7], "t2", [], "t3")
            put(tmp_path, symbol, day[:7], "t3", [bar(day, 2, vw=1.25, n=7)])
    return tmp_path


def read(spark, store, symbols=("AAA", "BBB")):
    return paged.paged_bars(spark, list(symbols), dt.date(2024, 1, 1), dt.date(2024, 3, 31), path=str(store))


def test_batch(spark, store):
    got = rows(read(spark, store), "symbol", "timestamp_utc")
    assert len(got) == 12 and got[2]["vwap"] == 1.25 and got[2]["transactions"] == 7 and got[0]["vwap"] is None and got[0]["timestamp_utc"] == dt.datetime(2024, 1, 5, 14)
    assert read(spark, store).rdd.getNumPartitions() == 6


def test_filters_open_only_the_chains_asked_for(spark, store):
    (store / "symbol=BBB" / "month=2024-01" / "token=first" / "part-0.txt").write_text("no page")
    (store / "symbol=AAA" / "month=2024-02" / "token=t3" / "part-0.txt").write_text("no page")
    found = read(spark, store).where("symbol = 'AAA' and timestamp_utc < timestamp'2024-01-05 14:02:00'")
    assert found.count() == 2 and found.rdd.getNumPartitions() == 1
    assert read(spark, store).where("symbol in ('BBB') and timestamp_utc >= timestamp'2024-02-03'").count() == 3
    assert read(spark, store).where("symbol = 'CCC'").count() == 0
    with pytest.raises(Exception, match="not JSON"):
        read(spark, store).count()


@pytest.mark.parametrize("token,text,fault", [
    ("t3", {"bars": {"AAA": []}, "next_page_token": "t2"}, "came again"), ("t3", {"next_page_token": None}, "no bars field"), ("t3", {"bars": {"ZZZ": []}}, "another symbol"), ("t3", {"bars": {"AAA": [{"t": "2024-01-05T14:00:00Z"}]}}, "lacks a field"),
    ("t3", {"bars": {"AAA": [bar("2024-01-05", 5) | {"t": "2024-01-05T14:00:00"}]}}, "naive"), ("t3", {"bars": {"AAA": [bar("2024-01-05", 5) | {"t": "2024-01-05T14:00:07Z"}]}}, "off the minute"), ("t3", {"bars": None, "next_page_token": "t9"}, "is not there"),
])
def test_broken_chains_fail(spark, store, token, text, fault):
    (store / "symbol=AAA" / "month=2024-01" / f"token={token}" / "part-0.txt").write_text(json.dumps(text))
    with pytest.raises(Exception, match=fault):
        read(spark, store, ["AAA"]).collect()


def test_stream_goes_on_behind_the_last_page(spark, store, tmp_path_factory):
    out = tmp_path_factory.mktemp("s")
    paged.register(spark)

    def run():
        stream = spark.readStream.format("paged_bars").options(path=str(store), symbols="AAA,BBB", start="2024-01-01", end="2024-02-29").load()
        stream.writeStream.format("parquet").option("path", f"{out}/t").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{out}/t")

    assert run().count() == 12
    assert run().count() == 12
    put(store, "AAA", "2024-02", "t3", [bar("2024-02-05", 2)], "t4")  # the last page got a follower
    put(store, "AAA", "2024-02", "t4", [bar("2024-02-05", 3), bar("2024-02-05", 4)], "t5")
    after = run()
    assert after.count() == 14 and after.distinct().count() == 14
    put(store, "AAA", "2024-02", "t5", [bar("2024-02-05", 6)], "t4")
    with pytest.raises(Exception, match="came again|STREAM"):
        run()


def test_recorded_by_spark(spark, tmp_path):
    bars = [(s, dt.datetime(2024, m, 3, 10, k, tzinfo=UTC), 1.0 + k, 2.0 + k, 0.5, 1.5, 5.0, None, k) for s in "XY" for m in (4, 5) for k in range(25)]
    df = spark.createDataFrame(bars, paged.SCHEMA)
    paged.record_pages(df, f"{tmp_path}/p", 10)
    back = paged.paged_bars(spark, ["X", "Y"], dt.date(2024, 4, 1), dt.date(2024, 5, 31), path=f"{tmp_path}/p")
    assert not back.exceptAll(df).take(1) and back.count() == 100
    with pytest.raises(Exception, match="symbols"):
        spark.read.format("paged_bars").options(path="x").load().count()
