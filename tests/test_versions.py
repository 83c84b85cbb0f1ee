"""Snapshots: readers pin a version, dead writers leave no trace, writers of the same partition conflict, refused attempts stay."""

import datetime as dt

import pytest
from helpers import rows

from tidemark.sources import versions
from tidemark.sources.versions import Conflict, VersionedTable

SCHEMA = "symbol string, year int, day int, x double"


def table(spark, root):
    return VersionedTable(spark, f"file://{root}/t", SCHEMA, ["symbol", "year"])


def batch(spark, *data):
    return spark.createDataFrame(data, SCHEMA)


def got(df):
    return sorted(tuple(r.values()) for r in rows(df))


def test_upserts_and_pinned_readers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FULL", 3)
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.state().version == -1
    assert t.upsert(batch(spark, ("A", 1, 1, 1.0), ("A", 2, 1, 2.0), ("B/é%", 1, 1, 3.0), (None, None, 1, 9.0)), ["symbol", "year", "day"]) == 0
    first = t.read()
    assert t.upsert(batch(spark, ("A", 1, 1, 10.0), ("A", 1, 2, 11.0)), ["symbol", "year", "day"]) == 1
    assert got(first.where("x < 9")) == [("A", 1, 1, 1.0), ("A", 2, 1, 2.0), ("B/é%", 1, 1, 3.0)]
    assert t.upsert(batch(spark, ("B/é%", 1, 1, 4.0)), ["symbol", "year", "day"]) == 2 and t.upsert(batch(spark, (None, None, 1, 8.0)), ["symbol", "year", "day"]) == 3
    assert {r[3] for r in got(t.read().where("symbol is null"))} == {8.0}
    assert got(t.read().where("symbol is not null")) == [("A", 1, 1, 10.0), ("A", 1, 2, 11.0), ("A", 2, 1, 2.0), ("B/é%", 1, 1, 4.0)]
    assert got(t.read(0).where("year = 2")) == [("A", 2, 1, 2.0)] and len(t.history()) == 4
    with pytest.raises(ValueError):
        t.read(9)


def test_a_dead_writer_leaves_the_table_readable(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(batch(spark, ("A", 1, 1, 1.0)), ["symbol", "year", "day"])
    before = got(t.read())

    def die(self, number, entry):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_put", die)
        with pytest.raises(KeyboardInterrupt):
            t.upsert(batch(spark, ("A", 1, 1, 5.0)), ["symbol", "year", "day"])
    assert got(t.read()) == before and t.vacuum(1, dt.timedelta(0)) == 1 and got(t.read()) == before


def test_two_writers(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(batch(spark, ("A", 1, 1, 1.0), ("B", 1, 1, 1.0)), ["symbol", "year", "day"])
    base = t.state()
    v, parts = t._write(batch(spark, ("A", 1, 1, 7.0)))
    t.upsert(batch(spark, ("B", 1, 1, 2.0)), ["symbol", "year", "day"])
    assert t.commit(base, v, parts, {}) == 2  # other partitions don't matter
    assert got(t.read()) == [("A", 1, 1, 7.0), ("B", 1, 1, 2.0)]
    v, parts = t._write(batch(spark, ("A", 1, 1, 8.0)))
    with pytest.raises(Conflict):
        t.commit(base, v, parts, {})
    assert got(t.read()) == [("A", 1, 1, 7.0), ("B", 1, 1, 2.0)]

    taken = []

    def beaten_once(df):
        if not taken:
            taken.append(1)
            t.upsert(batch(spark, ("A", 1, 5, 5.0)), ["symbol", "year", "day"])
        return None

    t.upsert(batch(spark, ("A", 1, 1, 9.0)), ["symbol", "year", "day"], accept=beaten_once)  # merged again on what the other wrote
    assert got(t.read()) == [("A", 1, 1, 9.0), ("A", 1, 5, 5.0), ("B", 1, 1, 2.0)]


def test_refused_attempts_stay_but_are_not_live(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(batch(spark, ("A", 1, 1, 1.0)), ["symbol", "year", "day"])
    assert t.upsert(batch(spark, ("A", 1, 2, -1.0)), ["symbol", "year", "day"], {"chunk": "A-1"}, accept=lambda df: "negative" if df.where("x < 0").take(1) else None) is None
    note = t.history()[-1]
    assert note["refused"] == "negative" and note["chunk"] == "A-1" and got(t.read()) == [("A", 1, 1, 1.0)]
    assert spark.read.parquet(f"{tmp_path}/t/data/v={note['attempt']}").count() == 2


def test_stream_replays_are_merged_once(spark, tmp_path):
    t = table(spark, tmp_path)
    batch(spark, ("A", 1, 1, 1.0), ("A", 1, 1, 2.0)).write.parquet(f"{tmp_path}/in")
    run = lambda: t.stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/c", ["symbol", "year", "day"], ["x"]).awaitTermination()
    run()
    batch(spark, ("A", 1, 1, 0.5)).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert got(t.read()) == [("A", 1, 1, 0.5)] and t.state().version == 1
    (tmp_path / "c" / "commits" / "1").unlink()
    (tmp_path / "c" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert t.state().version == 1 and got(t.read()) == [("A", 1, 1, 0.5)]
