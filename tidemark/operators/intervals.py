"""Date intervals: merging, contiguous watermark, gaps, and runs of equal reasons. All bounds are inclusive dates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERIFIED = ("complete", "complete_with_known_gaps", "empty")


def merged(intervals: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Islands of overlapping or adjacent (next day) intervals: keys, start, end, n."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("__new", F.when(reach.isNull() | (F.col(start) > F.date_add(reach, 1)), 1).otherwise(0))
    rows = rows.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*keys, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__island")


def verified(manifest: DataFrame, artifact_ok: Column | None = None) -> DataFrame:
    """Entries that count as coverage: a verified status and, if told, an intact artifact."""
    ok = F.col("status").isin(*VERIFIED)
    return manifest.where(ok if artifact_ok is None else ok & artifact_ok)


def watermark(intervals: DataFrame, keys: Sequence[str], dataset_start: Column) -> DataFrame:
    """The last date to which coverage runs from dataset_start without a hole; no row for keys where the first day is missing."""
    held = merged(intervals, keys).where((F.col("start") <= dataset_start) & (F.col("end") >= dataset_start))
    return held.select(*keys, F.col("end").alias("watermark"))


def coverage_gaps(intervals: DataFrame, keys: Sequence[str], first: Column, last: Column) -> DataFrame:
    """Parts of [first, last] that no interval covers, for each key that has any interval."""
    islands = merged(intervals, keys)
    cut = islands.where((F.col("end") >= first) & (F.col("start") <= last)).select(*keys, F.greatest("start", first).alias("s"), F.least("end", last).alias("e"))
    everyone = islands.select(*keys).distinct()
    edges = cut.unionByName(everyone.select(*keys, F.date_add(last, 1).alias("s"), F.date_add(last, 1).alias("e"))).unionByName(everyone.select(*keys, F.date_sub(first, 1).alias("s"), F.date_sub(first, 1).alias("e")))
    following = F.lead("s").over(Window.partitionBy(*keys).orderBy("s", "e"))
    gap = edges.select(*keys, F.date_add("e", 1).alias("start"), F.date_sub(following, 1).alias("end"))
    return gap.where(F.col("end").isNotNull() & (F.col("start") <= F.col("end")))


def runs(days: DataFrame, keys: Sequence[str], day: str, reason: str) -> DataFrame:
    """Consecutive days with the same reason: keys, reason, start, end, n."""
    order = Window.partitionBy(*keys).orderBy(day)
    new = F.when((F.lag(reason).over(order) == F.col(reason)) & (F.lag(day).over(order) == F.date_sub(F.col(day), 1)), 0).otherwise(1)
    rows = days.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order))
    return rows.groupBy(*keys, "__run", reason).agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count("*").alias("n")).drop("__run")


def classified_gaps(manifest: DataFrame, keys: Sequence[str], first: dt.date, last: dt.date, today: dt.date | None = None, artifact_ok: Column | None = None) -> DataFrame:
    """Why each uncovered day is uncovered, as runs: provisional, future, failed or missing. The entry fetched last speaks for a day.

    The range is cut where any entry begins or ends, so days between two cuts are all alike and no row stands for a day: work grows with
    the entries, and with the cuts that an entry spans. Neighbouring cuts with equal reasons are joined up.
    """
    lo, after = F.lit(first), F.date_add(F.lit(last), 1)
    ok = F.lit(True) if artifact_ok is None else F.coalesce(artifact_ok, F.lit(False))
    near = manifest.withColumn("__ok", ok).where((F.col("end") >= F.lit(first)) & (F.col("start") <= F.lit(last)) & (F.col("start") <= F.col("end")))
    near = near.select(*keys, F.greatest("start", lo).alias("__from"), F.least(F.date_add("end", 1), after).alias("__to"), "status", "__ok", "retrieved_at")
    # one row for each key: its cuts, ascending, and from each cut the entries up to their own ends
    split = [] if today is None else [F.least(F.greatest(F.date_add(F.lit(today), 1), lo), after)]
    cuts = near.groupBy(*keys).agg(F.collect_set("__from").alias("__f"), F.collect_set("__to").alias("__t"))
    everyone = manifest.select(*keys).distinct().join(cuts, list(keys), "left")
    none = F.array().cast("array<date>")
    all_cuts = F.array_sort(F.array_distinct(F.concat(F.coalesce("__f", none), F.coalesce("__t", none), F.array(lo, after, *split))))
    cut = everyone.select(*keys, all_cuts.alias("__cuts"))
    pieces = cut.select(*keys, F.posexplode("__cuts").alias("__p", "start"), F.col("__cuts")).select(*keys, "start", F.get("__cuts", F.col("__p") + 1).alias("__end")).where("__end is not null")
    spanned = near.join(cut, list(keys)).withColumn("start", F.explode(F.filter("__cuts", lambda c: (c >= F.col("__from")) & (c < F.col("__to")))))
    said = spanned.groupBy(*keys, "start").agg(F.max_by(F.struct("status", "__ok"), "retrieved_at").alias("x"), F.bool_or(F.col("status").isin(*VERIFIED) & F.col("__ok")).alias("__covered"))
    rows = pieces.join(said, [*keys, "start"], "left").where(~F.coalesce("__covered", F.lit(False)))
    status = F.col("x.status")
    unseen = F.lit("missing") if today is None else F.when(F.col("start") > F.lit(today), "future").otherwise("missing")
    reason = F.when(status.isNull(), unseen).when((status == "provisional") & F.col("x.__ok"), "provisional").when(status.isin("provisional", "failed", *VERIFIED), "failed").otherwise("missing")
    order = Window.partitionBy(*keys).orderBy("start")
    rows = rows.withColumn("reason", reason)
    new = F.when((F.lag("reason").over(order) == F.col("reason")) & (F.lag("__end").over(order) == F.col("start")), 0).otherwise(1)
    rows = rows.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order))
    out = rows.groupBy(*keys, "__run", "reason").agg(F.min("start").alias("start"), F.max("__end").alias("__end"))
    return out.select(*keys, "reason", "start", F.date_sub("__end", 1).alias("end"), F.datediff("__end", "start").cast("long").alias("n"))


def contiguous(days: DataFrame, keys: Sequence[str], day: str = "day") -> DataFrame:
    """first, last, n and whether every day between is there; whole_month: it is all of one calendar month."""
    out = days.groupBy(*keys).agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count_distinct(day).alias("n"))
    out = out.withColumn("contiguous", F.col("n") == F.datediff("last", "first") + 1)
    whole = F.col("contiguous") & (F.col("first") == F.trunc("first", "MM")) & (F.col("last") == F.last_day("first"))
    return out.withColumn("whole_month", whole)
