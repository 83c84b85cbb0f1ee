import datetime as dt

from pyspark.sql import functions as F

from helpers import rows
from tidemark.operators import dedup, intervals, series


def d(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def frame(spark, spans, key="k"):
    return spark.createDataFrame([(key, d(a), d(b)) for a, b in spans], "key string, start date, end date")


def test_merge_watermark_gaps(spark):
    f = frame(spark, [(0, 4), (5, 9), (2, 3), (15, 20), (18, 25)])
    assert [(r["start"], r["end"]) for r in rows(intervals.merged(f, ["key"]), "start")] == [(d(0), d(9)), (d(15), d(25))]
    assert [r["watermark"] for r in rows(intervals.watermark(f, ["key"], F.lit(d(0))))] == [d(9)]
    assert rows(intervals.watermark(f, ["key"], F.lit(d(-1)))) == []
    got = [(r["start"], r["end"]) for r in rows(intervals.coverage_gaps(f, ["key"], F.lit(d(-3)), F.lit(d(30))), "start")]
    assert got == [(d(-3), d(-1)), (d(10), d(14)), (d(26), d(30))]


def test_newest_evidence_classifies(spark):
    m = spark.createDataFrame(
        [("k", "failed", d(0), d(9), 1), ("k", "provisional", d(0), d(10), 2), ("k", "failed", d(5), d(6), 3), ("k", "complete", d(12), d(13), 4)], "key string, status string, start date, end date, retrieved_at int"
    )
    got = [(r["reason"], r["start"], r["end"]) for r in rows(intervals.classified_gaps(m, ["key"], d(0), d(16), d(15)), "start")]
    assert got == [("provisional", d(0), d(4)), ("failed", d(5), d(6)), ("provisional", d(7), d(10)), ("missing", d(11), d(11)), ("missing", d(14), d(15)), ("future", d(16), d(16))]


def test_contiguous(spark):
    days = spark.createDataFrame([("a", d(k)) for k in range(31)] + [("b", d(0)), ("b", d(2))], "key string, day date")
    got = {r["key"]: (r["contiguous"], r["whole_month"]) for r in rows(intervals.contiguous(days, ["key"]))}
    assert got == {"a": (True, True), "b": (False, False)}


def test_transforms(spark):
    def run(values, t):
        s = spark.createDataFrame([("s", d(31 * k), v) for k, v in enumerate(values)], "s string, d date, v double")
        return [round(r["value_out"], 6) for r in rows(series.transformed(s, ["s"], "d", "v", t), "d")]

    assert run([150000.0, 150216.0], "diff_1") == [216] and run([100.0, 100.3], "pct_change_1") == [0.3]
    assert run([0.0, 5.0, 10.0], "pct_change_1") == [100.0] and len(run([float(k + 1) for k in range(13)], "pct_change_12")) == 1
    assert run([1.0, None, 3.0], "identity") == [1, 3] and run([1.0, None, 3.0], "diff_1") == []


def test_upsert_new_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    out = dedup.upsert(old, new, ["k"])
    assert [(r["k"], r["v"]) for r in rows(out, "k")] == [(1, "a"), (2, "c"), (3, "d")] and dedup.unique_and_sorted(out, ["k"])
    assert rows(dedup.missing_from(spark.createDataFrame([("s", d(0)), ("s", d(2))], "s string, x date"), spark.createDataFrame([("s", d(0)), ("s", d(1)), ("s", d(5))], "s string, x date"), ["s"], "x"))[0]["x"] == d(1)
