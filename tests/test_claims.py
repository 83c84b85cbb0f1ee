"""Claims of manifest entries judged as of their own retrieval, and chunk states as a stream against the batch result."""

import datetime as dt
import random

import pytest
from helpers import BAR, UTC, ny, rows, walk
from pyspark.sql import functions as F

from tidemark.operators import claims
from tidemark.sources import registry, sessions
from tidemark.streaming import chunks

D1, D2, D3 = dt.date(2022, 3, 1), dt.date(2022, 3, 2), dt.date(2022, 3, 3)  # Tuesday to Thursday
SATURDAY = dt.date(2022, 3, 5)
ENTRY = "symbol string, claim string, status string, start date, end date, retrieved_at timestamp, path string, checksum string, error string, verified_at timestamp"


def session_table(spark):
    s = sessions.session_frame(spark, dt.date(2022, 2, 20), dt.date(2022, 3, 20))
    return s.select(F.col("ny_date").alias("session"), F.unix_micros("open").alias("open_us"), F.unix_micros("close").alias("close_us"))


def entry(claim, status, start, end, at, symbol="AAA", checksum="old"):
    return (symbol, claim, status, start, end, at, "f", checksum, None, None)


def gap(start, end, day=D2):
    at = lambda c: dt.datetime.fromisoformat(f"{day}T{c}").replace(tzinfo=UTC)
    told = {"id": "hole", "classification": "provider_gap", "status": "observed", "symbols": ["AAA"], "provider": "alpaca", "feed": "sip", "timezone": "UTC", "date": day.isoformat(), "start_local": start, "end_local": end, "retry_appropriate": False,
            "invalidates_event_window": True, "evidence": "seen twice", "source": "test", "start_utc": at(start), "end_utc": at(end)}
    return registry.parse_entry(told)


@pytest.fixture(scope="module")
def stored(spark):
    late = {ny(D2, 11) + k * dt.timedelta(minutes=1) for k in range(30)}
    data = walk("AAA", ny(D1, 9, 30), ny(D1, 16), 1) + walk("AAA", ny(D2, 9, 30), ny(D2, 16), 2, late) + walk("AAA", ny(D3, 9, 30), ny(D3, 12), 3)
    return spark.createDataFrame(data, BAR).withColumn("bar_us", F.unix_micros("timestamp_utc")).cache()


def test_each_claim_is_held_to_its_own_instant(spark, stored):
    noon3, after = ny(D3, 12), ny(D3, 18)
    entries = [
        entry("whole day", "complete", D1, D1, after), entry("holed", "complete", D2, D2, after), entry("in progress", "provisional", D3, D3, noon3), entry("later", "provisional", D3, D3, after), entry("early", "provisional", D1, D3, ny(D1, 9)),
        entry("weekend", "empty", SATURDAY, SATURDAY + dt.timedelta(1), after), entry("not empty", "empty", D1, D1, after), entry("due", "empty", dt.date(2022, 2, 24), dt.date(2022, 2, 25), after), entry("gone", "complete", dt.date(2022, 2, 24), dt.date(2022, 2, 25), after),
        entry("gaps", "complete_with_known_gaps", D2, D2, after), entry("bad", "failed", D2, D2, after), entry("other", "complete", D1, D1, after, "BBB"),
    ]
    frame = spark.createDataFrame(entries, ENTRY)
    got = {r["claim"]: (r["stands"], r["reason"]) for r in rows(claims.revalidated(frame, stored, session_table(spark)))}
    assert {k for k, v in got.items() if v[0]} == {"whole day", "in progress", "early", "weekend", "bad"}
    assert got["later"][1] == "the rows fail now: 1 sessions incomplete; 1 close edges" and got["due"][1].startswith("claimed empty") and got["not empty"][1].startswith("claimed empty") and got["other"][1] == got["gone"][1] == "the rows are gone"
    known = registry.registry_frame(spark, [gap("16:00", "16:30")])
    got = {r["claim"]: (r["stands"], r["reason"]) for r in rows(claims.revalidated(frame, stored, session_table(spark), registry=known))}
    assert got["gaps"][0] and got["holed"] == (False, "claimed complete, but passes by registered gaps only")
    sparse = {r["claim"]: r["stands"] for r in rows(claims.revalidated(frame, stored, session_table(spark), sparse=True))}
    assert sparse["later"] and sparse["holed"] and not sparse["gone"]


def test_statuses_of_fetched_chunks(spark, stored):
    c = spark.createDataFrame([("AAA", "a", D1, D1), ("AAA", "b", D2, D2), ("AAA", "c", SATURDAY, SATURDAY), ("BBB", "d", D1, D1), ("AAA", "e", D3, D3)], "symbol string, claim string, start date, end date").withColumn("as_of_us", F.lit(int(ny(D3, 12).timestamp()) * 1_000_000))
    broken = stored.unionByName(stored.where(F.col("timestamp_utc") == F.lit(ny(D1, 10))))

    def statuses(bars, **how):
        return {r["claim"]: r["status"] for r in rows(claims.fetched_status(claims.chunk_facts(c, bars, session_table(spark), **how), F.col("end") >= F.lit(D3)))}

    assert statuses(stored) == {"a": "complete", "b": "failed", "c": "empty", "d": "failed", "e": "provisional"}
    assert statuses(stored, registry=registry.registry_frame(spark, [gap("16:00", "16:30")]))["b"] == "complete_with_known_gaps"
    assert statuses(broken)["a"] == "failed" and statuses(stored.withColumn("high", F.when(F.col("timestamp_utc") == F.lit(ny(D1, 10)), float("nan")).otherwise(F.col("high"))))["a"] == "failed"


def test_rewritten_files(spark, stored):
    entries = spark.createDataFrame([entry("one", "complete", D1, D1, ny(D3, 18)), entry("two", "complete", D2, D2, ny(D3, 18)), entry("new", "complete", D1, D1, ny(D3, 18), checksum="now"), entry("failed", "failed", D1, D1, ny(D3, 18))], ENTRY)
    now = dt.datetime(2022, 4, 1, tzinfo=UTC)
    got = {r["claim"]: r for r in rows(claims.after_rewrite(entries, spark.createDataFrame([("f", "now")], "path string, checksum string"), stored, session_table(spark), now))}
    assert set(got) == {"one", "two"} and (got["one"]["status"], got["one"]["checksum"]) == ("complete", "now") and (got["two"]["status"], got["two"]["checksum"]) == ("failed", None)
    assert got["one"]["retrieved_at"] == ny(D3, 18).replace(tzinfo=None) and got["one"]["verified_at"] == now.replace(tzinfo=None) and got["two"]["error"].startswith("the rows fail now")


def attempts():
    rng, out = random.Random(5), []
    for k in range(12):
        first = dt.date(2024, 1 + k % 6, 1)
        last = first + dt.timedelta(27)
        for _ in range(rng.randint(1, 4)):
            at = dt.datetime(last.year, last.month, last.day, 12, tzinfo=UTC) + dt.timedelta(days=rng.randint(-20, 20))
            out.append(("p", f"S{k // 6}", first, last, at, rng.choice([0, 50, 60]), rng.random() < 0.2, rng.choice([0, 0, 3]), rng.choice([None, None, None, "no answer"])))
    return out


def run_stream(spark, folder, batches):
    for k, data in enumerate(batches):
        spark.createDataFrame(data, chunks.ATTEMPT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        def keep(df, number, to=f"{folder}/out{k}"):
            df.write.mode("append").parquet(to)

        states = chunks.chunk_state_stream(spark.readStream.schema(chunks.ATTEMPT).parquet(f"{folder}/in"), 5, "240 days")
        states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    found = [r for k in range(len(batches)) for r in rows(spark.read.parquet(f"{folder}/out{k}"))]
    last = {}
    for r in found:  # the last row by retrieval speaks; an overdue one follows its provisional
        key = r["key"], r["start"]
        if key not in last or (r["retrieved_at"], r["status"] == "overdue") >= (last[key]["retrieved_at"], last[key]["status"] == "overdue"):
            last[key] = r
    return {k: r["status"] for k, r in last.items()}


def test_stream_of_attempts_gives_the_batch_result(spark, tmp_path):
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        data = attempts()
        random.Random(1).shuffle(data)
        flush = ("p", "flush", dt.date(2024, 1, 1), dt.date(2024, 1, 28), dt.datetime(2025, 12, 31, tzinfo=UTC), 1, False, 0, None)
        table = spark.createDataFrame([*data, flush], chunks.ATTEMPT)
        plain = {(r["key"], r["start"]): r["status"] for r in rows(chunks.chunk_states(table, 5, F.lit(dt.datetime(2025, 5, 5, tzinfo=UTC)).cast("timestamp")))}
        assert {"overdue", "failed"} <= set(plain.values()) and "provisional" not in plain.values()
        # out of order, then replayed, then the end of all overlaps
        got = run_stream(spark, f"file://{tmp_path}", [data[: len(data) // 2], data[len(data) // 2 :] + data[:5], [flush], [flush]])
        assert got == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old[1])
