"""What manifest entries claim about stored bars, judged against the bars that are there now, each as of its own retrieval.

A chunk's entry says that its days were complete, empty or provisional when it was fetched. A table rewritten for another chunk, a repaired file or a new registry may have changed what is there,
so the claim is judged anew: the sessions begun by the entry's own instant, on what of them had elapsed. All entries go through one plan: their days meet sessions and daily defect counts by equality.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import MINUTE_US, ny_date
from .bars import DEFECTS, claimed_sessions, integrity

#: Statuses that claim something about stored rows.
CLAIMS = ("complete", "complete_with_known_gaps", "empty", "provisional")


def chunk_facts(claims: DataFrame, bars: DataFrame, sessions: DataFrame, by: Sequence[str] = ("symbol",), step_us: int = MINUTE_US, sparse: bool = False, registry: DataFrame | None = None, provider: str = "alpaca", feed: str = "sip", day: Column | None = None) -> DataFrame:
    """A row for each claim (by, claim, start, end, as_of_us): stored_rows, expected_trading_sessions, known_gap_minutes, structural_defects, is_hard_failure and issues, what the failure is made of.

    bars: by, bar_us, prices, volume; `day` is their date (that of New York). sessions: session (a date), open_us, close_us.
    """
    s = claimed_sessions(claims, sessions, bars, by, step_us, registry=registry, provider=provider, feed=feed)
    v = F.col("verdict")
    found = s.groupBy(*by, "claim").agg(
        F.count("*").alias("expected_trading_sessions"), F.sum("known_missing").alias("known_gap_minutes"), F.count_if(v == "missing").alias("sessions_missing"), F.count_if(v == "incomplete").alias("sessions_incomplete"),
        F.count_if("missing_open_edge").alias("open_edges"), F.count_if("missing_close_edge").alias("close_edges"),
    )
    daily = integrity(bars.withColumn("__date", ny_date(F.timestamp_micros("bar_us")) if day is None else day), [*by, "__date"], minutes=step_us // MINUTE_US, volume_factor=None)
    days = claims.select(*by, "claim", F.explode(F.sequence("start", "end")).alias("__date"))
    rows = days.join(daily, [*by, "__date"]).groupBy(*by, "claim").agg(F.sum("total_rows").alias("stored_rows"), F.sum(sum((F.col(c) for c in DEFECTS), F.lit(0))).alias("structural_defects"))
    out = claims.join(found, [*by, "claim"], "left").join(rows, [*by, "claim"], "left")
    counts = ("stored_rows", "structural_defects", "expected_trading_sessions", "known_gap_minutes", "sessions_missing", "sessions_incomplete", "open_edges", "close_edges")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})
    hard = ("structural_defects", "sessions_missing") if sparse else ("structural_defects", "sessions_missing", "sessions_incomplete", "open_edges", "close_edges")
    issue = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(" " + c.replace("_", " ")))) for c in hard]))
    return out.withColumns({"is_hard_failure": sum((F.col(c) for c in hard), F.lit(0)) > 0, "issues": F.array_join(issue, "; ")})


def fetched_status(facts: DataFrame, provisional: Column) -> DataFrame:
    """facts with status and error, as a chunk just fetched earns them: rows are never complete for being there, and no rows are only empty where no session was due."""
    none = F.col("stored_rows") == 0
    due = F.col("expected_trading_sessions") > 0
    status = (
        F.when(none & ~due, "empty").when(none | F.col("is_hard_failure"), "failed").when(provisional, "provisional").when(F.col("known_gap_minutes") > 0, "complete_with_known_gaps").otherwise("complete")
    )
    error = F.when(none & due, F.concat(F.col("expected_trading_sessions").cast("string"), F.lit(" sessions were due and no bar came"))).when(~none & F.col("is_hard_failure"), F.col("issues"))
    return facts.withColumns({"status": status, "error": error})


def revalidated(entries: DataFrame, bars: DataFrame, sessions: DataFrame, by: Sequence[str] = ("symbol",), **how) -> DataFrame:
    """entries (by, claim, status, start, end, retrieved_at) with stands, and reason where a claim doesn't stand any more.

    Only claims about rows are judged (CLAIMS); failed entries come back as they are. `how` goes to chunk_facts.
    """
    claims = entries.where(F.col("status").isin(*CLAIMS)).select(*by, "claim", "start", "end", F.unix_micros("retrieved_at").alias("as_of_us"))
    facts = chunk_facts(claims, bars, sessions, by, **how).select(*by, "claim", "stored_rows", "expected_trading_sessions", "known_gap_minutes", "is_hard_failure", "issues")
    none = F.col("stored_rows") == 0
    reason = (
        F.when((F.col("status") == "empty") & ((F.col("expected_trading_sessions") > 0) | ~none), "claimed empty, but sessions are due or rows are stored").when(F.col("status") == "empty", None)
        .when(none, "the rows are gone").when(F.col("is_hard_failure"), F.concat(F.lit("the rows fail now: "), F.col("issues"))).when((F.col("status") == "complete") & (F.col("known_gap_minutes") > 0), "claimed complete, but passes by registered gaps only")
    )
    out = entries.join(facts, [*by, "claim"], "left").withColumn("reason", F.when(F.col("status").isin(*CLAIMS), reason))
    return out.withColumn("stands", F.col("reason").isNull())


def after_rewrite(entries: DataFrame, rewritten: DataFrame, bars: DataFrame, sessions: DataFrame, verified_at: dt.datetime, by: Sequence[str] = ("symbol",), **how) -> DataFrame:
    """New manifest rows for the claims that share a rewritten file (path, checksum) and still carry another checksum: the checksum renewed where the claim stands (retrieved_at stays), `failed` where it doesn't."""
    r = rewritten.select("path", F.col("checksum").alias("__now")).distinct()
    shared = entries.where(F.col("status").isin(*CLAIMS)).join(r, "path").where(~F.col("checksum").eqNullSafe(F.col("__now")))
    judged = revalidated(shared, bars, sessions, by, **how)
    now = F.lit(verified_at).cast("timestamp")
    return judged.select(
        *[F.col(c) for c in entries.columns if c not in ("status", "checksum", "error", "verified_at")], F.when(F.col("stands"), F.col("status")).otherwise("failed").alias("status"), F.when(F.col("stands"), F.col("__now")).alias("checksum"),
        F.when(F.col("stands"), F.col("error")).otherwise(F.col("reason")).alias("error"), now.alias("verified_at"),
    )
