"""Descriptors, snapshots, the reconciliation's table, redaction, and the entry points."""

import datetime as dt
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from helpers import BAR, MINUTE, UTC, extended_hours, ny, rows, walk
from tidemark import cli
from tidemark.operators import bars, descriptor, reconcile
from tidemark.sources import feeds, sessions, snapshots
from tidemark.sources.sessions import session_frame
from tidemark.store import smallest_reached

DAYS = [dt.date(2022, 12, 29), dt.date(2022, 12, 30), dt.date(2023, 1, 3)]


def frame(spark, drop=()):
    data = [b for k, d in enumerate(DAYS) for b in extended_hours("AAA", d, k, drop)]
    return spark.createDataFrame(data, BAR).withColumn("bar_us", F.unix_micros("timestamp_utc"))


def slots(spark):
    s = session_frame(spark, DAYS[0], DAYS[-1])
    return s.select(F.col("ny_date").alias("session"), F.unix_micros("open").alias("open_us"), F.unix_micros("close").alias("close_us"))


def test_descriptor(spark, tmp_path):
    full = descriptor.descriptor(frame(spark), slots(spark), 60_000_000)
    full.write.parquet(f"{tmp_path}/d")
    full = spark.read.parquet(f"{tmp_path}/d")
    by = {r["year"]: r for r in rows(full)}
    assert {y: (r["rows"], r["expected_sessions"], r["regular_observed_minutes"], r["validation"]) for y, r in by.items()} == {2022: (1920, 2, 780, "clean"), 2023: (960, 1, 390, "clean")}
    again = descriptor.descriptor(frame(spark).repartition(5), slots(spark), 60_000_000)
    assert descriptor.differences(full, again).count() == 0 and descriptor.fingerprint_of(full) == descriptor.fingerprint_of(again)
    less = descriptor.descriptor(frame(spark, {ny(DAYS[0], 9, 30) + k * MINUTE for k in range(20)}), slots(spark), 60_000_000)
    (d,) = rows(descriptor.differences(full, less))
    assert (d["year"], d["kind"]) == (2022, "changed") and {"rows", "content_sha256", "regular_observed_minutes"} <= set(d["fields"]) and descriptor.fingerprint_of(less) != descriptor.fingerprint_of(full)
    assert {r["kind"] for r in rows(descriptor.differences(full, full.where("year = 2022")))} == {"lost"}
    year = {r["year"]: r for r in rows(less)}[2022]
    assert (year["validation"], year["sessions_missing_open_edge"], year["incomplete_sessions"]) == ("failed", [DAYS[0]], [DAYS[0]])


def test_sparse_feeds_fail_on_structure_only(spark):
    b = frame(spark, {ny(DAYS[0], 9, 30) + k * MINUTE for k in range(20)})
    s, i = bars.slot_coverage(b, slots(spark), ["symbol"], 60_000_000), bars.integrity(b, ["symbol"])
    assert [rows(bars.validation_report(i, s, ["symbol"], sparse))[0]["is_hard_failure"] for sparse in (False, True)] == [True, False]
    gaps = rows(bars.session_gaps(b.where("bar_us % 7 <> 0 or true"), slots(spark), ["symbol"], 60_000_000))
    assert gaps == []  # the missing minutes are at the open: no step inside the session
    b = frame(spark, {ny(DAYS[1], 11, k) for k in range(3, 9)})
    assert rows(bars.session_gaps(b, slots(spark), ["symbol"], 5 * 60_000_000)) == [{"symbol": "AAA", "gaps_in_sessions": 1, "longest_gap_us": 7 * 60_000_000}]
    pos = spark.createDataFrame([("a", k, u) for k, u in enumerate([1, 2, 5, 4, 6, 6])], "symbol string, pos int, bar_us long")
    assert rows(bars.out_of_order(pos, ["symbol"], "pos"))[0]["unsorted_rows"] == 1


def test_snapshots(spark, tmp_path):
    root = f"{tmp_path}/GDP"
    df = spark.createDataFrame([("GDP", dt.date(2020, k, 1), float(k)) for k in range(1, 5)], "series_id string, date date, value double")
    key = ["series_id", "date"]
    (tmp_path / "GDP").mkdir()
    assert snapshots.latest_verified(spark, root) is None
    first = snapshots.save_snapshot(df, root, key, dt.datetime(2021, 1, 1))
    assert snapshots.save_snapshot(df.limit(0), root, key, dt.datetime(2021, 1, 2)) is None and snapshots.latest_verified(spark, root).count() == 4
    df.limit(2).write.mode("overwrite").parquet(f"{root}/{first}")
    assert snapshots.latest_verified(spark, root) is None
    (tmp_path / "f").write_bytes(b"abc")
    assert snapshots.file_checksum(f"{tmp_path}/f") == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_offset_pages():
    data = list(range(25))
    assert snapshots.offset_pages(lambda o: (data[o : o + 10], 25), 10) == data
    for bad in (lambda o: (data[o : o + 10] if o < 20 else [], 25), lambda o: (data[o : o + 10], 25 + o), lambda o: (data[:10], 25), lambda o: (data[o : o + 11], 25)):
        with pytest.raises(RuntimeError):
            snapshots.offset_pages(bad, 10)
    assert snapshots.offset_pages(lambda o: ([], 0), 10) == []


def test_components(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    got = {r["node"]: r["root"] for r in rows(smallest_reached(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {x: top(x) for a, b in edges for x in (a, b) if a != b}


def test_release_table(spark):
    at = lambda d, h: dt.datetime(2023, *d, h, 30, tzinfo=UTC)
    period = lambda m: dt.date(2023, m, 1)
    cal = [
        (1, "A", "F", "B1", period(1), at((2, 14), 13), None, 0.5, "PERCENT", 0.4, None, None), (2, "B", "F", "B1", period(1), None, at((2, 14), 13), 0.5, "PERCENT", 0.4, None, None),
        (3, "A", "F", "B1", period(2), at((3, 14), 12), None, 0.4, "PERCENT", 0.5, None, None), (4, "B", "F", "B1", None, None, at((3, 15), 12), 0.6, "PERCENT", None, None, None),
        (5, "A", "G", "B1", period(2), at((3, 20), 12), None, 1.0, "PERCENT", None, None, None), (6, "A", "G", "B1", period(2), at((3, 21), 12), None, 1.1, "PERCENT", None, None, None),
        (7, "B", "H", "B2", period(2), None, at((3, 22), 12), 2.0, "PERCENT", None, None, None), (8, "B", "H", "B2", period(2), None, None, 2.0, "PERCENT", None, None, None), (9, "A", "F", "B1", period(9), at((10, 12), 12), None, 0.1, "PERCENT", None, None, None),
    ]
    schema = "row_id long, source string, event_family string, release_bundle string, reference_period date, release_timestamp_utc timestamp, converted_utc timestamp, actual double, actual_unit string, previous double, revised_previous double, semantic_issue string"
    calendars = spark.createDataFrame(cal, schema)
    official = spark.createDataFrame([("F", period(1), dt.date(2023, 2, 14), 0.52, "PERCENT"), ("F", period(2), dt.date(2023, 3, 14), 0.4, "PERCENT"), ("F", period(1), dt.date(2023, 3, 14), 0.5, "PERCENT"), ("X", period(1), dt.date(2023, 2, 14), 9.0, "PERCENT")], "event_family string, period date, vintage_date date, value double, unit string")
    got = rows(reconcile.release_table(calendars, official, "2023-02-01", "2023-03-31"))
    assert [(r["release_no"], r["canonical_event_id"], r["source_match_status"]) for r in got] == [(1, "F:2023-01", "MATCH"), (3, "F:2023-02", "VALUE_CONFLICT"), (5, "G:2023-02", "AMBIGUOUS_CANDIDATES"), (7, "H:2023-02", "MISSING_SOURCE")]
    first, second, third, last = got
    assert first["release_actual_match_status"] == "ROUNDING_MATCH" and first["trusted_release_timestamp_basis"] == "CALENDAR_A"
    assert (second["previous_release_date"], second["previous_official"], second["previous_validation_status"]) == (dt.date(2023, 2, 14), 0.52, "rounding_match")
    assert third["actual_value"] is None and last["trusted_release_timestamp_utc"] is None and last["trusted_release_timestamp_basis"] is None
    assert third["notes"].startswith("several rows of one calendar") and last["notes"] == "the only time is a server time of a zone that nobody has validated" and first["sources_present"] == "A+B+OFFICIAL" and first["a_minus_b"] == 0.0
    assert (first["a_actual_match_status"], second["b_actual_match_status"], first["official_vintage_lag_days"]) == ("rounding_match", "value_mismatch", 0)
    rich = calendars.withColumns({"source_url": F.concat(F.lit("u"), F.col("row_id").cast("string")), "actual_raw_text": F.lit("0.5%")})
    mixed = official.unionByName(spark.createDataFrame([("F", period(5), dt.date(2023, 2, 20), 1.0, "THOUSANDS")], official.schema))
    one = rows(reconcile.release_table(rich, mixed, "2023-02-01", "2023-03-31"))[0]
    assert (one["a_source_url"], one["b_source_url"], one["a_actual_raw_text"], one["official_unit"]) == ("u1", "u2", "0.5%", "PERCENT")  # another vintage's unit doesn't matter
    trusted = rows(reconcile.release_table(calendars, official, "2023-02-01", "2023-03-31", timezone_trusted=True))
    assert {r["release_no"]: r["trusted_release_timestamp_basis"] for r in trusted}[7] == "CALENDAR_B_VALIDATED_ZONE"
    assert rows(reconcile.undated(calendars, "2023-02-01", "2023-03-31")) == [{"source": "B", "n": 1}]
    assert reconcile.require_single_family(calendars.where("row_id < 5")) == "F"
    with pytest.raises(ValueError):
        reconcile.require_single_family(calendars)


def test_raw_rows_and_counts(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿name,actual,forecast\n A ,1, \nB,,2\nbroken\n", encoding="utf-8")
    raw = rows(feeds.read_raw_csv(spark, f"{tmp_path}/c.csv"), "pos")
    assert [(r["name"], r["actual"], r["forecast"]) for r in raw] == [(" A ", "1", " "), ("B", "", "2")]
    mapping = spark.createDataFrame([("a",)], "name string")
    assert rows(feeds.import_counts(feeds.read_raw_csv(spark, f"{tmp_path}/c.csv"), mapping, ("actual", "forecast"))) == [{"rows": 2, "mapped": 1, "unmapped": 1, "with_actual": 1, "with_forecast": 1}]
    for d in ("feed=sip", "feed=odd", "_tmp"):
        (tmp_path / "s" / d).mkdir(parents=True)
    assert feeds.known_datasets(spark, f"{tmp_path}/s", ["sip", "iex"]) == (["sip"], ["odd"])


class Provider:
    """Bars of every session; BBB lacks a day, and March fails."""

    def fetch(self, spark, key, start, end):
        if start.month == 3:
            raise ConnectionError("apikey=abc12345 refused")
        days = [d for d, _, _ in sessions.sessions(start, end) if not (key == "BBB" and d == dt.date(2023, 1, 12))]
        data = [b for k, d in enumerate(days) for b in walk(key, ny(d, 9, 30), ny(d, 16), k)]
        return spark.createDataFrame(data, BAR)


def test_fetching(spark, tmp_path, capsys, monkeypatch):
    run = lambda *a: cli.main([str(x) for x in a], spark)
    monkeypatch.syspath_prepend(__file__.rsplit("/", 1)[0])
    out = f"file://{tmp_path}/store"
    source = ("--provider", "test_reports:Provider", "--start", "2023-01-01", "--out", out)

    def statuses():
        return {(r["key"], r["start"].month): r["status"] for r in cli.current(spark, f"{out}/manifest").collect()}

    assert run("fetch-historical-data", *source, "--symbols", "AAA", "--today", "2023-02-28") == 0
    assert statuses() == {("AAA", 1): "complete", ("AAA", 2): "provisional"}
    table = cli.stored_bars(spark, out)
    n = table.read().count()
    assert n == 390 * len(sessions.sessions(dt.date(2023, 1, 1), dt.date(2023, 2, 28))) and table.state().version == 1
    assert run("update-data", *source, "--symbols", "AAA", "--today", "2023-02-28") == 0 and table.state().version == 2 and table.read().count() == n  # only what is provisional is fetched again
    first = [r for r in cli.current(spark, f"{out}/manifest").collect() if r["start"].month == 1]
    assert first[0]["status"] == "complete" and first[0]["checksum"] == "2"  # judged again in the rewritten partition
    assert run("fetch-historical-data", *source, "--symbols", "AAA,BBB", "--today", "2023-03-02") == 1
    assert statuses() == {("AAA", 1): "complete", ("AAA", 2): "complete", ("AAA", 3): "failed", ("BBB", 1): "failed", ("BBB", 2): "complete", ("BBB", 3): "failed"}
    errors = {(r["key"], r["start"].month): r["error"] for r in cli.current(spark, f"{out}/manifest").collect()}
    assert errors["BBB", 1].startswith("1 sessions missing") and "refused" in errors["AAA", 3] and "abc12345" not in errors["AAA", 3]
    # a month that loses rows loses its claim when its partition is rewritten
    cut = cli.stored_bars(spark, out)
    base = cut.state()
    v, parts = cut._write(table.read().where("symbol = 'AAA' and not timestamp_utc between '2023-01-10' and '2023-01-11'"))
    cut.commit(base, v, parts, {})
    assert run("update-data", *source, "--symbols", "AAA", "--today", "2023-02-28") == 1 and statuses()["AAA", 1] == "failed"
    capsys.readouterr()


def test_validation_of_a_span_as_of_an_instant(spark, tmp_path, capsys):
    run = lambda *a: cli.main(["validate-data", "--bars", f"{tmp_path}/{a[0]}", *a[1:]], spark)
    days = [dt.date(2023, 1, 3), dt.date(2023, 1, 4)]
    full = [b for k, d in enumerate(days) for b in walk("AAA", ny(d, 9, 30), ny(d, 16), k)]
    begun = walk("AAA", ny(dt.date(2023, 1, 5), 9, 30), ny(dt.date(2023, 1, 5), 11, 30), 5)
    frame = lambda data: spark.createDataFrame(data, BAR).coalesce(1)
    frame(full + begun).write.parquet(f"{tmp_path}/now")
    assert run("now", "--as-of", "2023-01-05T11:30:00-05:00") == 0 and run("now") == 1 and run("now", "--end", "2023-01-04") == 0
    assert run("now", "--start", "2022-12-01", "--end", "2023-01-04") == 1 and run("now", "--end", "2023-01-31", "--as-of", "2023-01-05T11:30:00-05:00") == 0 and run("now", "--end", "2023-01-31") == 1
    assert run("now", "--end", "2023-01-04", "--symbols", "AAA,BBB") == 1 and run("now", "--start", "2023-02-01", "--end", "2023-01-01") == 2 and run("now", "--as-of", "2023-01-05T11:30:00") == 2
    frame(full[::-1]).write.parquet(f"{tmp_path}/reversed")
    assert run("reversed") == 1 and "unsorted_rows" in capsys.readouterr().out
    frame(full).withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/naive")
    assert run("naive") == 1
    capsys.readouterr()


def test_provenance_is_checked_in_the_read(spark, tmp_path):
    day, late = dt.date(2023, 1, 3), dt.date(2023, 6, 1)
    mine = spark.createDataFrame(walk("AAA", ny(day, 9, 30), ny(day, 10), 1), BAR).withColumns({"source": F.lit("X"), "feed": F.lit("sip"), "year": F.lit(2023)})
    other = spark.createDataFrame(walk("AAA", ny(late, 9, 30), ny(late, 10), 2), BAR).withColumns({"source": F.lit("Y"), "feed": F.lit(None).cast("string"), "year": F.lit(2023)})
    mine.write.partitionBy("symbol", "year").parquet(f"{tmp_path}/a")
    mine.unionByName(other).write.partitionBy("symbol", "year").parquet(f"{tmp_path}/b")
    seen, want = Observation(), {"source": "X", "feed": "sip"}
    good = feeds.read_bars(spark, f"{tmp_path}/a", ["AAA"], day, day, want, seen=seen)
    assert good.count() == 30 and seen.get == {"rows": 30, "source_faults": 0, "feed_faults": 0}
    foreign = feeds.read_bars(spark, f"{tmp_path}/b", ["AAA"], day, day, want)  # the foreign rows lie outside the clip
    assert foreign._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    with pytest.raises(Exception, match="another dataset, by source, feed"):
        foreign.count()
    assert feeds.read_bars(spark, f"{tmp_path}/b", ["AAA"], day, day).count() == 30
    with pytest.raises(Exception, match="another dataset"):
        feeds.read_bars(spark, f"{tmp_path}/a", ["AAA"], day, day, {"adjustment": "raw"}).count()
    mine.drop("source", "feed").write.partitionBy("symbol", "year").parquet(f"{tmp_path}/old")
    assert feeds.read_bars(spark, f"{tmp_path}/old", ["AAA"], day, day, want, "X").count() == 30


def test_entry_points(spark, tmp_path, capsys):
    run = lambda *a: cli.main([str(x) for x in a], spark)
    p = lambda n: f"{tmp_path}/{n}"
    stored = spark.createDataFrame([b for k, d in enumerate(DAYS) for b in extended_hours("AAA", d, k)], BAR)
    stored.withColumn("source", F.lit("X")).coalesce(1).write.parquet(p("bars"))
    assert run("build-dataset-descriptor", "--bars", p("bars"), "--out", p("desc"), "--check") == 2
    assert run("build-dataset-descriptor", "--bars", p("bars"), "--out", p("desc")) == 0 and run("build-dataset-descriptor", "--bars", p("bars"), "--out", p("desc"), "--check") == 0
    spark.read.parquet(p("bars")).where("volume > 100").write.parquet(p("fewer"))
    assert run("build-dataset-descriptor", "--bars", p("fewer"), "--out", p("desc"), "--check") == 1
    assert run("validate-data", "--bars", p("bars")) == 0 and run("validate-data", "--bars", p("fewer")) == 1
    spark.createDataFrame([("r", "AAA", ny(DAYS[1], 10))], "release_id string, symbol string, release_ts timestamp").write.parquet(p("releases"))
    assert run("build-macro-market-response", "--releases", p("releases"), "--bars", p("bars"), "--out", p("response"), "--source", "X") == 0 and run("build-macro-market-response", "--releases", p("releases"), "--bars", p("bars"), "--out", p("r2"), "--source", "Y") == 1
    assert rows(spark.read.parquet(p("response")))[0]["market_window_status"] == "OK"
    sides = ("--side-a", "a/X/sip/all/raw/1min", "--side-b", "b/Y/sip/all/raw/1min")
    assert run("compare-market-providers", "--a", p("bars"), "--b", p("fewer"), "--out", p("cmp"), *sides) == 0 and run("compare-market-providers", "--a", p("bars"), "--b", p("fewer"), "--out", p("cmp"), "--side-a", "a/X/sip/all/raw/1min", "--side-b", "a/X/sip/all/raw/1min") == 2
    cal = [(f"e{k}", "CPI_MOM", "CPI", ny(d, 8, 30), "CONFIRMED", 0.3, 0.2, "PERCENT") for k, d in enumerate(DAYS)]
    spark.createDataFrame(cal, "event_id string, event_family string, release_bundle string, release_timestamp_utc timestamp, timestamp_quality string, actual double, provider_forecast double, actual_unit string").write.parquet(p("calendar"))
    study = ("build-event-response-dataset", "--calendar", p("calendar"), "--symbols", "AAA", "--out", p("study"))
    (tmp_path / "study" / "reports").mkdir(parents=True)
    (tmp_path / "study" / "reports" / "report_old.csv").write_text("x")
    (tmp_path / "study" / "reports" / "report_others.csv").write_text("x")
    (tmp_path / "study" / "reports" / "inventory.json").write_text('{"report_old.csv": {}}')
    assert run(*study, "--bars", p("fewer"), "--descriptor", p("desc")) == 1 and run(*study, "--bars", p("bars"), "--descriptor", p("desc")) == 0
    facts = json.loads((tmp_path / "study" / "dataset.json").read_text())
    assert facts["outputs"]["event_response"]["rows"] == 3 and facts["outputs"]["event_response_windows"]["rows"] == 33 and not (tmp_path / "study" / "reports" / "report_old.csv").exists() and (tmp_path / "study" / "reports" / "report_others.csv").exists()
    assert run("no-such-command") == 2 and run("validate-data") == 2
    capsys.readouterr()
