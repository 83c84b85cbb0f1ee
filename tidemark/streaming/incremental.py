"""Incremental acquisition as Structured Streaming: micro-batches upserted into partitions, with a manifest.

A batch's bars replace stored ones with the same key (new wins, whatever the arrival order of files), only in the partitions that it touches. The manifest
says how far each chunk is; coverage, watermark and gaps are computed from it (operators.intervals), not from event time, because a hole must stop it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import keep_last, upsert
from ..operators.intervals import VERIFIED


def chunk_status(rows: Column, hard_failure: Column, known_gaps: Column, in_progress: Column, error: Column) -> Column:
    """failed, provisional, empty, complete_with_known_gaps, complete; the first that holds."""
    return F.when(error.isNotNull() | hard_failure, "failed").when(in_progress, "provisional").when(rows == 0, "empty").when(known_gaps > 0, "complete_with_known_gaps").otherwise("complete")


def is_provisional(end: Column, today: dt.date, overlap_days: int) -> Column:
    """Late corrections are still expected: the chunk ends within the trailing days that are always fetched again."""
    return end >= F.lit(today - dt.timedelta(days=overlap_days))


def to_fetch(chunks: DataFrame, manifest: DataFrame, today: dt.date, overlap_days: int, artifact_ok: Column | None = None) -> DataFrame:
    """Chunks (key, start, end) to fetch: not verified with an intact artifact, or still provisional."""
    done = manifest.where(F.col("status").isin(*VERIFIED) & (F.lit(True) if artifact_ok is None else artifact_ok)).select("key", "start", "end").distinct()
    return chunks.join(done.where(~is_provisional(F.col("end"), today, overlap_days)), ["key", "start", "end"], "left_anti")


def stale_siblings(manifest: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Entries that share a file with a rewritten one and were verified before: to be checked again as of their own retrieval."""
    r = rewritten.select(F.col("path").alias("__p"), F.col("checksum").alias("__c")).distinct()
    return manifest.join(r, (F.col("path") == F.col("__p")) & (F.col("checksum") != F.col("__c")), "left_semi")


def write_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Overwrites exactly the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def upsert_partitions(batch: DataFrame, path: str, keys: Sequence[str], partitions: Sequence[str], staging: str) -> None:
    """Merges a batch into a partitioned table. The touched partitions are read, merged and staged before any is replaced, so a failed task leaves the table as it was."""
    spark = batch.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001  an absent table has its own error class in each catalog
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        stored = None
    if stored is not None:
        touched = batch.select(*partitions).distinct()
        stored = stored.join(touched, list(partitions), "left_semi").select(*batch.columns)
    upsert(stored, batch, keys).write.mode("overwrite").parquet(staging)
    write_partitions(spark.read.parquet(staging), path, partitions)


def stream_upsert(source: DataFrame, path: str, checkpoint: str, keys: Sequence[str], partitions: Sequence[str], order: Sequence[str], on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """A stream of bars or events into the table, to the end of what is there. Within a batch the greatest `order` of a key wins, across batches the later batch."""

    def merge(batch: DataFrame, number: int) -> None:
        latest = keep_last(batch, keys, *order)
        upsert_partitions(latest, path, keys, partitions, f"{checkpoint}/staging/{number % 2}")
        if on_batch:
            on_batch(latest, number)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(source: DataFrame, ts: str, late: str, width: str, slide: str | None, *by: str) -> DataFrame:
    """Counts in tumbling or sliding windows of event time; rows later than `late` are left out."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return source.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def record(manifest_path: str, rows: DataFrame) -> None:
    """Appends manifest entries; the latest by retrieved_at, then by verified_at, of (provider, key, start, end) speaks."""
    rows.write.mode("append").parquet(manifest_path)


def current(spark: SparkSession, manifest_path: str) -> DataFrame:
    entries = spark.read.parquet(manifest_path)
    return keep_last(entries, ["provider", "key", "start", "end"], "retrieved_at", *(["verified_at"] if "verified_at" in entries.columns else []))
