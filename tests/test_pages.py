import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tidemark.sources import pages, registry

TABLE = """<html><head><meta charset="utf-8"></head><body><table>
<tr><td class="calendar__event">ahead of all dates</td></tr>
<tr><td class="calendar__date">Mon Feb 6</td><td class="calendar__time">7:45pm</td><td class="calendar__currency">NZD</td><td class="calendar__impact"><span class="icon icon--ff-impact-red"></span></td><td class="calendar__event">Milk Auction</td><td class="calendar__graph"><span class="red"></span></td><td class="calendar__actual">3.1%</td><td class="calendar__forecast">2.2%</td><td class="calendar__previous">-1.0%</td></tr>
<tr><td class="calendar__date"></td><td class="calendar__time"></td><td class="calendar__currency">usd</td><td class="calendar__impact"><span class="icon--ff-impact-yel"></span></td><td class="calendar__event">Wheat &amp; Oats Stocks</td><td class="calendar__graph"></td><td class="calendar__actual"></td></tr>
<tr><td class="calendar__date">Tue Feb 7</td><td class="calendar__time"></td><td class="calendar__event">Panel on Tides</td><td class="calendar__graph"><span class="ora"></span></td></tr>
<tr><td class="calendar__time">All Day</td><td class="calendar__currency">USD</td><td class="calendar__impact red"><span class="icon--ff-impact-gra"></span></td><td class="calendar__event"> milk AUCTION </td></tr>
</table></body></html>"""


def page(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")


def test_table_carries_dates_and_times(spark):
    got = rows(pages.calendar_rows(page(spark, TABLE, None, "<p>no table")), "page_id", "row_no")
    assert [(r["day_text"], r["time_text"], r["name"], r["impact"]) for r in got] == [
        ("Mon Feb 6", "7:45pm", "Milk Auction", "HIGH"), ("Mon Feb 6", "7:45pm", "Wheat & Oats Stocks", "LOW"), ("Tue Feb 7", None, "Panel on Tides", "NONE"), ("Tue Feb 7", "All Day", "milk AUCTION", "NONE"),
    ]
    assert got[0]["actual"] == "3.1%" and got[1]["actual"] is None


def test_impact_is_of_the_first_class_with_a_mark(spark):
    cases = {"icon red": "HIGH", "orange-x": "MEDIUM", "yellow": "LOW", "gray": "NONE", "x grey yel": "NONE", "yel red": "LOW", "plain": "NONE", "": "NONE", None: "NONE"}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r["c"]: r["i"] for r in df.select("c", pages.impact(F.col("c")).alias("i")).collect()} == cases


def test_embedded_states(spark):
    feb = 1_675_641_600  # 6 February 2023, 00:00
    days = [{"date": "Feb 6", "dateline": feb, "events": [{"id": "31", "name": "A ] [ {", "dateline": feb + 71_100, "actual": "x"}, {"id": "32", "name": "B", "date": "Feb 7"}]}, {"date": "Feb 8", "dateline": feb + 172_800, "events": []}]
    again = [{"date": "Feb 6", "dateline": feb, "events": [{"id": "31", "name": "A", "actual": "y"}]}]
    html = f"<script>calendarComponentStates[1] = {{ days: {json.dumps(days)}, x: 1}}; calendarComponentStates[2] = {{ days: [oops ]}}; calendarComponentStates[3] = {{days: {json.dumps(again)}}};</script>"
    got = rows(pages.calendar_states(page(spark, html, TABLE)), "id")
    assert [(r["id"], r["actual"], r["day_text"]) for r in got] == [("31", "y", "Feb 6"), ("32", None, "Feb 7")]
    both = rows(pages.calendar(page(spark, html, TABLE)), "page_id")
    assert sum(r["page_id"] == 0 for r in both) == 2 and sum(r["page_id"] == 1 for r in both) == 4
    assert [r["day"] for r in rows(pages.rendered_days(page(spark, html), "UTC"), "day")] == [dt.date(2023, 2, 6), dt.date(2023, 2, 8)]


def test_page_rows_become_events(spark):
    mapping = spark.createDataFrame([("Milk Auction", "MILK", "milk price", "DAIRY"), ("wheat & oats stocks", "GRAIN", "stocks", "GRAINS")], "name string, event_family string, indicator string, release_bundle string")
    table = pages.calendar(page(spark, TABLE))
    got = rows(pages.event_rows(table, mapping, 2023, "USD", "America/New_York", attested=True), "event_id")
    assert [(r["event_id"], r["event_family"], r["timestamp_quality"]) for r in got] == [("ff:2023-02-06:usd:7:45pm:Wheat & Oats Stocks", "GRAIN", "CONFIRMED"), ("ff:2023-02-07:USD:All Day:milk AUCTION", "MILK", "TENTATIVE")]
    assert got[0]["release_timestamp_utc"].replace(tzinfo=dt.timezone.utc) == dt.datetime(2023, 2, 7, 0, 45, tzinfo=dt.timezone.utc) and got[1]["release_timestamp_utc"] is None
    every = rows(pages.event_rows(table, mapping, 2023), "event_id")
    milk = [r for r in every if r["actual"] is not None]
    assert len(every) == 3 and [(r["actual"], r["actual_unit"], r["provider_forecast"], r["previous"], r["importance"], r["timestamp_quality"], r["reference_period"]) for r in milk] == [(3.1, "PERCENT", 2.2, -1.0, "HIGH", "UNRESOLVED", dt.date(2023, 1, 1))]
    own = [{"date": "Feb 6", "dateline": 0, "events": [{"id": "31", "name": "Milk Auction", "dateline": 1_675_712_700, "currency": "NZD", "impactClass": "icon red", "actual": "1K", "revision": "2K"}]}]
    state = page(spark, f"calendarComponentStates[1] = {{ days: {json.dumps(own)} }}")
    (r,) = rows(pages.event_rows(pages.calendar(state), mapping, 2023))
    assert (r["event_id"], r["timestamp_quality"], r["actual"], r["actual_unit"], r["revised_previous"], r["importance"]) == ("ff:31", "CONFIRMED", 1.0, "THOUSANDS", 2.0, "HIGH")
    assert r["release_timestamp_utc"].replace(tzinfo=dt.timezone.utc) == dt.datetime(2023, 2, 6, 19, 45, tzinfo=dt.timezone.utc)


def test_charset():
    assert pages.decode(b'<meta charset="cp1252">\x80') == '<meta charset="cp1252">€' and pages.decode("é".encode()) == "é" and pages.decode(b"\x80") == "€" and pages.decode(b"\x81") == "\x81"
    assert pages.decode(b'<meta charset="no-such">ok').endswith("ok")


def entry(**more):
    told = {
        "id": "storm", "classification": "provider_gap", "status": "observed", "symbols": ["AAA"], "provider": "alpaca", "feed": "sip", "timezone": "America/New_York", "date": "2021-11-16", "start_local": "10:07", "end_local": "11:40",
        "start_utc": "2021-11-16T15:07:00Z", "end_utc": "2021-11-16T16:40:00Z", "retry_appropriate": False, "invalidates_event_window": True, "evidence": "seen twice", "source": "test",
    }
    return {k: v for k, v in (told | more).items() if v is not ...}


@pytest.mark.parametrize(
    "bad",
    [
        {"id": ""}, {"classification": "x"}, {"status": "x"}, {"symbols": []}, {"start_utc": "2021-11-16T15:07:00"}, {"end_utc": "2021-11-16T15:07:00Z"}, {"start_local": "11:07"}, {"date": "2021-11-17"}, {"date": ...}, {"evidence": " "}, {"source": ""},
        {"retry_appropriate": "no"}, {"retry_appropriate": ...}, {"invalidates_event_window": ...}, {"start_utc": "2021-11-16T15:07:15Z"}, {"provider": "*"}, {"feed": "*"}, {"feed": ""}, {"timezone": ...}, {"timezone": "Mars/Olympus"}, {"start_local": ...},
        {"end_local": "noon"}, {"classification": "temporary_fetch_failure"},
    ],
)
def test_registry_refuses(bad):
    assert registry.parse_entry(entry())["id"] == "storm"
    with pytest.raises(registry.RegistryError):
        registry.parse_entry(entry(**bad))


def test_registry(spark):
    parsed = registry.parse_registry({"schema_version": 1, "registry_version": 1, "entries": [entry(), entry(id="old", status="retired"), entry(id="pause", symbols="*", provider="*", classification="market_wide_halt")]})
    assert registry.content_hash(parsed) == registry.content_hash(parsed[::-1])
    with pytest.raises(registry.RegistryError):
        registry.parse_registry({"schema_version": 1, "registry_version": 1, "entries": [entry(), entry()]})
    at = lambda h, m: dt.datetime(2021, 11, 16, h, m, tzinfo=dt.timezone.utc)
    w = spark.createDataFrame([("in", "AAA", at(16, 0), at(16, 5)), ("touch", "AAA", at(15, 0), at(15, 7)), ("other", "BBB", at(16, 0), at(16, 5))], "id string, symbol string, a timestamp, b timestamp")
    frame = registry.registry_frame(spark, parsed)
    got = {r["id"]: r["exception_ids"] for r in rows(registry.query_windows(w, frame, ["id"], "a", "b"))}
    assert got == {"in": ["pause", "storm"], "touch": [], "other": ["pause"]}


def test_entries_meet_rows_by_equality(spark):
    """Days and scopes in place of a nested loop; a pair comes once however many days both touch."""
    at = lambda d, h=0: dt.datetime(2021, 11, d, h, tzinfo=dt.timezone.utc)
    from pyspark.sql import functions as F

    parsed = [registry.parse_entry(entry(id=f"e{k}", symbols=who)) | {"start_utc": at(a), "end_utc": at(z)} for k, (who, a, z) in enumerate([(["AAA"], 10, 14), (["AAA", "*"], 12, 20), (["BBB"], 11, 12)])]
    w = spark.createDataFrame([(0, "AAA", at(9), at(21)), (1, "AAA", at(13), at(13, 1)), (2, "BBB", at(12), at(12)), (3, "BBB", at(11, 23), at(12, 1)), (4, "CCC", at(1), at(2))], "k int, symbol string, a timestamp, b timestamp")
    pairs = registry.met(w, registry.registry_frame(spark, parsed), F.col("symbol"), F.unix_micros("a"), F.unix_micros("b"), parsed[0]["provider"], parsed[0]["feed"])
    assert sorted((r["k"], r["x_id"]) for r in rows(pairs)) == [(0, "e0"), (0, "e1"), (1, "e0"), (1, "e1"), (3, "e1"), (3, "e2")]
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString() and "Cartesian" not in pairs._jdf.queryExecution().toString()


def test_a_page_in_parts_is_read_as_one(spark):
    row = lambda date, time, name: f'<tr><td class="calendar__date">{date}</td><td class="calendar__time">{time}</td><td class="calendar__event">{name}</td></tr>'
    table = [row("", "", "early"), row("Mon", "8:00", "a"), row("", "", "b"), row("", "9:00", "c"), row("", "", ""), row("", "", "d"), row("Tue", "", "e"), row("", "", "f"), row("", "7:00", "g"), row("Mon", "", "h")]
    whole = spark.createDataFrame([(1, "".join(table)), (2, row("Wed", "1:00", "x"))], "page_id long, html string")
    expected = sorted(map(tuple, pages.calendar_rows(whole).collect()))
    assert len(expected) == 9
    for size in (1, 2, 3, 7):
        cut = [(1, k, "".join(table[k : k + size])) for k in range(0, len(table), size)] + [(2, 5, row("Wed", "1:00", "x"))]
        got = pages.calendar_rows(spark.createDataFrame(cut, "page_id long, part long, html string").repartition(3), part_col="part")
        assert sorted(map(tuple, got.collect())) == expected
