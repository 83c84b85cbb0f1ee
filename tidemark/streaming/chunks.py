"""Chunk states as a stateful stream: attempts at chunks come in, what each chunk is comes out.

An attempt's own outcome is `chunk_status`. The latest attempt by retrieval speaks for its chunk, whatever the order in which attempts arrive, and an attempt that comes twice changes nothing. A provisional chunk
doesn't stay so: once every attempt retrieved up to the end of its overlap is in (the watermark has passed it) and none has settled it, a timer ends it as `overdue`, to be fetched again. State is one
attempt for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedup import keep_last
from .incremental import chunk_status

KEY = ("provider", "key", "start", "end")
ATTEMPT = "provider string, key string, start date, end date, retrieved_at timestamp, rows long, hard_failure boolean, known_gaps long, error string"
STATE = "provider string, key string, start date, end date, status string, retrieved_at timestamp, rows long, error string"


def _outcome(attempts: DataFrame, overlap_days: int) -> DataFrame:
    """attempts with what each makes of its chunk, and until when a provisional one holds."""
    open_still = F.date_add("end", overlap_days) >= F.to_date("retrieved_at")
    status = chunk_status(F.col("rows"), F.col("hard_failure"), F.col("known_gaps"), open_still, F.col("error"))
    return attempts.withColumns({"status": status, "until": F.date_add("end", overlap_days + 1).cast("timestamp")})


def _best() -> Column:
    """The order of attempts: by retrieval, and by outcome where two were retrieved at once."""
    return F.struct("retrieved_at", "status", "rows", "error")


def chunk_states(attempts: DataFrame, overlap_days: int, seen_until: Column | None = None) -> DataFrame:
    """The states of a whole table of attempts, as of an instant up to which all attempts are known (the latest retrieval)."""
    best = keep_last(_outcome(attempts, overlap_days).withColumn("__o", _best()), list(KEY), "__o")
    now = seen_until if seen_until is not None else F.lit(None).cast("timestamp")
    over = (F.col("status") == "provisional") & (F.col("until") <= now)
    return best.select(*KEY, F.when(F.coalesce(over, F.lit(False)), "overdue").otherwise(F.col("status")).alias("status"), "retrieved_at", "rows", "error")


class _States(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "retrieved_at timestamp, status string, rows long, error string, until timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        order = lambda r: (r[0], r[1], r[2], r[3] is not None, r[3] or "")
        held = tuple(self.latest.get()) if self.latest.exists() else None
        best = held
        for frame in rows:
            for r in frame[["retrieved_at", "status", "rows", "error", "until"]].itertuples(index=False, name=None):
                r = (r[0].to_pydatetime(), r[1], int(r[2]), None if pd.isna(r[3]) else r[3], r[4].to_pydatetime())
                if best is None or order(r) > order(best):
                    best = r
        if best is None or best == held:
            return
        self.latest.update(best)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if best[1] == "provisional":
            self.handle.registerTimer(int(best[4].timestamp() * 1000))
        yield self._row(key, best, best[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        held = tuple(self.latest.get())
        if held[1] == "provisional":
            yield self._row(key, held, "overdue")

    @staticmethod
    def _row(key, held: tuple, status: str) -> pd.DataFrame:  # noqa: ANN001
        return pd.DataFrame({**dict(zip(KEY, ([k] for k in key), strict=True)), "status": [status], "retrieved_at": [held[0]], "rows": [held[2]], "error": [held[3]]})

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """What stateful processors need: a state store with column families, and one clock for driver and workers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def chunk_state_stream(attempts: DataFrame, overlap_days: int, late: str) -> DataFrame:
    """A row each time that a chunk's state changes. Attempts that come later than `late` after ones retrieved later are lost to the stream, as they are to any; choose it as long as a retry may take."""
    prepare(attempts.sparkSession)
    told = _outcome(attempts, overlap_days).withWatermark("retrieved_at", late)
    return told.groupBy(*KEY).transformWithStateInPandas(_States(), STATE, "Update", "EventTime")
