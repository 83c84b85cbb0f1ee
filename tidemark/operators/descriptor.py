"""Descriptors of stored bars: what a dataset holds, by symbol and year, and whether it still does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bar_hash
from ..functions.times import ny_date
from . import bars as bar_ops

BY = ("symbol", "year")
#: What identifies a dataset; a descriptor may hold more.
SUBSET = ("rows", "content_sha256", "expected_sessions", "represented_sessions", "regular_expected_minutes", "regular_observed_minutes", "known_gap_minutes", "excluded_minutes", "unexplained_missing_minutes", "first_us", "last_us")


def descriptor(bars: DataFrame, sessions: DataFrame, step_us: int, minutes: int = 1, registry: DataFrame | None = None, as_of_us: int | None = None, sparse: bool = False) -> DataFrame:
    """A row for each symbol and New York year: SUBSET, the defect and session counts of the validation report, and validation (clean, usable, failed).

    bars: symbol, bar_us, open, high, low, close, volume. sessions: session (date), open_us, close_us.
    """
    yearly = bars.withColumn("year", F.year(ny_date(F.timestamp_micros("bar_us"))))
    facts = bar_hash(yearly, BY).join(yearly.groupBy(*BY).agg(F.min("bar_us").alias("first_us"), F.max("bar_us").alias("last_us")), list(BY))
    slots = bar_ops.slot_coverage(bars, sessions, ["symbol"], step_us, as_of_us, registry=registry).withColumn("year", F.year("session"))
    report = bar_ops.validation_report(bar_ops.integrity(yearly, BY, minutes=minutes), slots, BY, sparse)
    named = {
        "expected_trading_sessions": "expected_sessions", "sessions_present": "represented_sessions", "expected_regular_minutes": "regular_expected_minutes", "covered_minutes": "regular_observed_minutes", "excluded_regular_minutes": "excluded_minutes",
    }
    out = facts.join(report.withColumnsRenamed(named), list(BY), "left")
    return out.withColumn("validation", F.when(F.col("is_hard_failure"), "failed").when(F.col("is_clean"), "clean").otherwise("usable"))


def fingerprint(rows: DataFrame, subset: Sequence[str] = SUBSET) -> Column:
    """One hash over the subset of a whole descriptor, for agg: rows in order of symbol and year (some hundred of them)."""
    line = F.to_json(F.struct(*BY, *sorted(subset)), {"ignoreNullFields": "false"})
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*BY, line.alias("l")))), lambda r: r["l"]), "\n"), 256)


def fingerprint_of(rows: DataFrame, subset: Sequence[str] = SUBSET) -> str:
    return rows.agg(fingerprint(rows, subset).alias("f")).first()["f"]


def differences(committed: DataFrame, current: DataFrame, fields: Sequence[str] = SUBSET) -> DataFrame:
    """(symbol, year, kind, fields): lost, added or changed rows, and which fields changed. Empty if both describe the same data."""
    a, b = (d.select(*BY, F.struct(*fields).alias(n)) for d, n in ((committed, "a"), (current, "b")))
    changed = F.filter(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields]), lambda x: x.isNotNull())
    both = a.join(b, list(BY), "full_outer").withColumn("fields", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), changed))
    kind = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "added").when(F.size("fields") > 0, "changed")
    return both.withColumn("kind", kind).where("kind is not null").select(*BY, "kind", "fields")
