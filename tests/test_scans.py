"""Scans against plain windows and sorted lists, with one hot group."""

import math
import random
import statistics

import pytest
from helpers import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.times import DAY_US
from tidemark.operators import scans


def hot(spark, n=3000):
    rng = random.Random(3)
    data = [(k, "hot" if k % 10 else rng.choice(["a", None]), rng.choice([None, *[rng.randrange(40 * DAY_US)] * 9]) if k % 7 else (k // 50) * DAY_US, rng.choice([None, 100 + rng.gauss(0, 1e-3), round(rng.gauss(0, 3), 1)])) for k in range(n)]
    return data, spark.createDataFrame(data, "k int, g string, t long, v double").repartition(5)


def test_earlier_equals_a_plain_window(spark):
    data, df = hot(spark)
    w = Window.partitionBy("g").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    v = F.when(F.col("t").isNotNull(), F.col("v"))
    plain = {r["k"]: r for r in rows(df.select("k", "t", F.count(v).over(w).alias("n"), F.avg(v).over(w).alias("m"), F.stddev_samp(v).over(w).alias("s"), F.max(F.abs(v)).over(w).alias("x"), F.max(F.when(v.isNotNull(), F.col("t"))).over(w).alias("at")))}
    found = scans.earlier(df, ["g"], "t", {"a": F.col("v"), "b": F.when(F.col("k") % 2 == 0, F.col("v"))})
    got = rows(found)
    assert len(got) == len(data) and found.columns[:4] == df.columns
    close = lambda a, b: a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    for r in got:
        p = plain[r["k"]]
        if p["t"] is None:
            assert r["a_n"] == 0 and r["a_m"] is None
            continue
        assert r["a_n"] == p["n"] and r["a_t"] == p["at"] and close(r["a_m"], p["m"]) and close(r["a_s"], p["s"]) and close(r["a_x"], p["x"]), (r, p)
        assert r["b_n"] <= r["a_n"]


@pytest.fixture
def small_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_group_is_many_tasks(spark, small_partitions):
    _, df = hot(spark)
    held = scans.earlier(df.where("g = 'hot'"), ["g"], "t", {"a": F.col("v")}).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(held) > 1 and max(r["count"] for r in held) < 2000
    place = scans.running_total(spark.range(5000).selectExpr("'one' as g", "id as o", "id % 3 as amount"), ["g"], "o", "amount")
    assert len(place.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()) > 1
    total = 0
    for r in sorted(rows(place), key=lambda r: r["o"]):
        assert r["before"] == total
        total += r["amount"]


def test_ranks_and_quantiles(spark):
    data, df = hot(spark)
    by = {}
    for _, g, _, v in data:
        by.setdefault(g, [])
        if v is not None:
            by[g].append(v)
    shares = {"low": 0.05, "median": 0.5, "top": 1.0, "odd": 0.3337}
    got = {r["g"]: r for r in rows(scans.quantiles(df, ["g"], "v", shares))}
    for g, values in by.items():
        values = sorted(values)
        assert got[g]["median"] == statistics.median(values) and got[g]["top"] == values[-1]
        for name, share in shares.items():
            at = share * (len(values) - 1)
            lo, hi = values[math.floor(at)], values[math.ceil(at)]
            assert math.isclose(got[g][name], lo + (hi - lo) * (at - math.floor(at)), rel_tol=1e-12, abs_tol=1e-12)
    for r in rows(scans.average_rank(df, ["g"], "v", "rank")):
        less, same = sum(x < r["v"] for x in by[r["g"]]) if r["v"] is not None else None, by[r["g"]].count(r["v"])
        assert r["rank"] == (None if r["v"] is None else less + (same + 1) / 2)
    wide = {r["g"]: r for r in rows(scans.quantile_columns(df, ["g"], {"v": F.col("v"), "neg": -F.col("v")}, {"median": 0.5}).where("g is not null"))}
    assert wide["hot"]["neg_median"] == -wide["hot"]["v_median"]
    assert not rows(scans.quantiles(df.where("false"), ["g"], "v", shares))
