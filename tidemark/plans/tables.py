"""The driver's tables seen as the engine's: events as ticks, bars and releases, orders as intervals and series, lineitems as vintages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def us(c: str) -> Column:
    """A naive column's microseconds on its own clock, taken as UTC."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", us("ts").alias("t_us"), "user_id", F.col("event_type").alias("symbol"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


def event_bars(spark: SparkSession, sf_dir: str, step_us: int = HOUR_US, where: Column | None = None) -> DataFrame:
    t = ticks(spark, sf_dir)
    return bars.from_ticks(t if where is None else t.where(where), "symbol", "t_us", "event_id", "value", step_us)


def ntz(c: Column) -> Column:
    """Microseconds as a naive UTC timestamp, for results."""
    return F.timestamp_micros(c).cast("timestamp_ntz")
