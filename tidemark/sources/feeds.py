"""Text and JSON feeds as DataFrames: calendar exports, window logs, official series, vendor bar pages, stored tables.

Whatever breaks a feed's contract either drops the row (where the contract says so) or carries a named fault; `require_sound` turns
faults into an error, so an unexpected shape is never read as no data.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import present
from ..functions.times import MINUTE_US, local_to_utc, prior_month
from ..operators.dedup import keep_last
from ..schema import BAR_RAW, MACRO_EVENT, conform

#: The calendar export's columns in order, those it can't do without, and its schema version.
CALENDAR_COLUMNS = (
    "value_id", "event_id", "event_name", "country_code", "currency_code", "importance", "event_time", "period", "unit", "multiplier", "actual_value", "forecast_value", "prev_value", "revised_prev_value", "revision", "source_timezone",
)
CALENDAR_REQUIRED = ("event_id", "event_name", "country_code", "currency_code", "importance", "event_time")
EXPORT_VERSION = "5"
LOG_COLUMNS = ("window_start", "window_end", "country", "currency", "schema_version", "status", "row_count", "attempts", "logged_at", "digest")


def read_calendar_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by the file's own header; rows with too few or too many fields are dropped. `pos` is the place in the file.

    Raises if a required column is absent. Files of older exports have no value_id (one is made of event and time), multiplier or period.
    """
    head = [r["value"] for r in spark.read.text(path).limit(1).collect()]
    names = head[0].lstrip("﻿").strip().split(",") if head else []
    lacking = [c for c in CALENDAR_REQUIRED if c not in names]
    if lacking:
        raise ValueError(f"{path}: missing columns {lacking}")
    schema = ", ".join(f"`{n}` string" for n in names) + ", __bad string"
    # without pruning, rows of a wrong length are seen whichever columns a query needs
    reader = spark.read.option("columnPruning", "false")
    raw = reader.csv(path, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad", multiLine=False, nullValue="\u0000", emptyValue="")
    rows = raw.withColumn("pos", F.monotonically_increasing_id()).where(F.col("__bad").isNull()).drop("__bad")
    made = {c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in names else F.lit(None).cast("string") for c in CALENDAR_COLUMNS}
    made["value_id"] = F.coalesce(made["value_id"], F.concat_ws(":", F.lit("legacy"), "event_id", "event_time"))
    for c in ("multiplier", "source_timezone"):
        made[c] = F.coalesce(made[c], F.lit("UNKNOWN"))
    return rows.select(*[c.alias(n) for n, c in made.items()], "pos")


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """All fields as they stand, blanks and all, by the file's own header, with `pos`: what digests are taken of."""
    head = [r["value"] for r in spark.read.text(path).limit(1).collect()]
    names = head[0].lstrip("\ufeff").strip().split(",") if head else []
    rows = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()).where(F.regexp_replace("value", "\ufeff", "") != F.lit(head[0].lstrip("\ufeff") if head else ""))
    cells = F.split(F.regexp_replace("value", "\r$", ""), ",", -1)
    return rows.where(F.size(cells) == len(names)).select(*[cells[k].alias(n) for k, n in enumerate(names)], "pos")


def import_counts(rows: DataFrame, mapping: DataFrame, fields: Sequence[str] = ("actual", "forecast", "previous")) -> DataFrame:
    """One row: rows, mapped and unmapped by name, and for each field the rows that are not blank."""
    known = mapping.select(F.lower(F.trim("name")).alias("__name")).distinct().withColumn("__known", F.lit(True))
    named = rows.withColumn("__name", F.lower(F.trim("name"))).join(known, "__name", "left")
    filled = [F.count_if(F.trim(F.coalesce(F.col(f), F.lit(""))) != "").alias(f"with_{f}") for f in fields]
    return named.agg(F.count("*").alias("rows"), F.count_if("__known").alias("mapped"), F.count_if(F.col("__known").isNull()).alias("unmapped"), *filled)


def calendar_values(rows: DataFrame) -> DataFrame:
    """The export's numbers as numbers; a text that is none is an error, as the export only writes numbers or nothing."""
    doubles = {c: F.col(c).cast("double") for c in ("actual_value", "forecast_value", "prev_value", "revised_prev_value")}
    return rows.withColumns(doubles | {"revision": F.col("revision").cast("int")})


def normalised_calendar(rows: DataFrame, mapping: DataFrame, zone: str | None, checksum: str | None = None, retrieved: dt.datetime | None = None) -> DataFrame:
    """Calendar rows as events. Rows with unmapped names or unreadable times are dropped; without a confirmed server zone the instant stays null and UNRESOLVED.

    mapping: label_key, event_family, indicator, release_bundle, value_unit, rule_unit, rule_multiplier.
    """
    key = F.lower(F.regexp_replace(F.trim("event_name"), r"\s+", " "))
    r = calendar_values(rows).withColumn("label_key", key).join(mapping, "label_key")
    at = F.try_to_timestamp("event_time", F.lit("yyyy.MM.dd HH:mm:ss")).cast("timestamp_ntz")
    r = r.withColumn("__at", at).where("__at is not null")
    known = (F.upper("unit") == "PERCENT") & (F.col("value_unit") == "PERCENT")
    ruled = F.col("rule_unit").isNotNull() & (F.col("unit") == F.col("rule_unit")) & (F.col("multiplier") == F.col("rule_multiplier"))
    unit = F.when(known | ruled, F.col("value_unit")).otherwise("UNKNOWN")
    period = F.coalesce(F.to_date(F.try_to_timestamp("period", F.lit("yyyy.MM.dd"))), prior_month(F.to_date("__at")))
    out = r.select(
        F.concat(F.lit("mql5:"), "value_id").alias("event_id"), "event_family", "indicator", "release_bundle", period.alias("reference_period"),
        (local_to_utc(F.col("__at"), zone) if zone else F.lit(None).cast("timestamp")).alias("release_timestamp_utc"), F.lit("CONFIRMED" if zone else "UNRESOLVED").alias("timestamp_quality"), F.col("actual_value").alias("actual"),
        unit.alias("actual_unit"), F.col("forecast_value").alias("provider_forecast"), unit.alias("provider_forecast_unit"), F.lit("MQL5").alias("forecast_source"), F.col("prev_value").alias("previous"), unit.alias("previous_unit"),
        F.col("revised_prev_value").alias("revised_previous"), "unit", "importance", F.lit("MQL5").alias("source"), F.col("event_id").alias("source_event_id"), F.col("__at").alias("source_timestamp"), F.lit(zone or "UNKNOWN").alias("source_timezone"),
        F.lit(checksum).alias("raw_artifact_checksum"), F.lit(retrieved).cast("timestamp").alias("retrieval_timestamp_utc"),
    )
    return conform(out, MACRO_EVENT)


def read_window_log(spark: SparkSession, path: str, country: str, currency: str) -> DataFrame:
    """The last well-formed line of each window: exactly ten fields, this country, currency and version, a whole count, and a digest if the status is OK."""
    text = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    fields = F.split("value", ",", -1)
    r = text.where(F.size(fields) == len(LOG_COLUMNS)).select(*[fields[k].alias(c) for k, c in enumerate(LOG_COLUMNS)], "pos")
    r = r.withColumn("status", F.upper(F.trim("status"))).withColumn("row_count", F.col("row_count").try_cast("long"))
    good = (F.col("country") == country) & (F.col("currency") == currency) & (F.col("schema_version") == EXPORT_VERSION) & F.col("row_count").isNotNull() & ((F.col("status") != "OK") | (F.col("digest") != ""))
    return keep_last(r.where(good), ["window_start", "window_end"], "pos").drop("pos")


def official_observations(spark: SparkSession, path: str) -> DataFrame:
    """Official series files {series_id, retrieved_at, observations: [{date, value, realtime_start}]}: '.' and blanks are missing, rows without a readable date are dropped."""
    schema = "series_id string, retrieved_at string, observations array<struct<date:string,value:string,realtime_start:string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    o = raw.select("series_id", F.try_to_timestamp("retrieved_at").alias("retrieved_at"), F.explode("observations").alias("o"))
    value = F.when(F.trim("o.value").isin(".", ""), None).otherwise(F.col("o.value").try_cast("double"))
    return o.select("series_id", F.col("o.date").try_cast("date").alias("date"), value.alias("value"), F.col("o.realtime_start").try_cast("date").alias("vintage_date"), "retrieved_at").where("date is not null")


def periodic_observations(rows: DataFrame) -> DataFrame:
    """Year and period ('M03', 'Q02', 'A01') rows as dates; unreadable values are missing, unreadable years dropped."""
    year, kind, n = F.col("year").try_cast("int"), F.substring("period", 1, 1), F.substring("period", 2, 2).try_cast("int")
    month = F.when((kind == "M") & n.between(1, 12), n).when((kind == "Q") & n.between(1, 4), n * 3 - 2).when(kind == "A", 1)
    return rows.withColumn("date", F.make_date(year, month, F.lit(1))).withColumn("value", F.col("value").try_cast("double")).where("date is not null")


def year_windows(first: int, last: int, most: int) -> list[tuple[int, int]]:
    return [(y, min(y + most - 1, last)) for y in range(first, last + 1, most)]


def as_of(vintages: DataFrame, day: dt.date) -> DataFrame:
    """What a series looked like on a day: of each date the latest vintage up to then. A filter on vintage_date, so a vintage-partitioned table is pruned."""
    return keep_last(vintages.where(F.col("vintage_date") <= F.lit(day)), ["series_id", "date"], "vintage_date")


_BAR = "struct<t:string,o:double,h:double,l:double,c:double,v:double,vw:double,n:bigint>"


def keyed_bars(pages: DataFrame, symbol: str, start: dt.datetime, end: dt.datetime, json_col: str = "json") -> DataFrame:
    """Bar pages {bars: {SYMBOL: [...]}, next_page_token}: raw bars with a fault each (null if sound).

    Faults: not_json, no_bars_field, other_symbol, missing_field, naive_timestamp, off_grid, outside_window.
    """
    parsed = F.from_json(json_col, f"struct<bars:map<string,array<{_BAR}>>,next_page_token:string>")
    p = pages.withColumn("__p", parsed).withColumn("__has", F.get_json_object(json_col, "$.bars").isNotNull() | F.col(json_col).rlike(r'"bars"\s*:\s*null'))
    page_fault = F.when(F.get_json_object(json_col, "$").isNull(), "not_json").when(~F.col("__has"), "no_bars_field")
    p = p.withColumn("__fault", page_fault)
    b = p.select("__fault", F.explode_outer(F.col("__p.bars")).alias("who", "list")).select("__fault", "who", F.explode_outer("list").alias("b"))
    zoned = F.col("b.t").rlike(r"(Z|[+-]\d\d:?\d\d)$")
    ts = F.try_to_timestamp("b.t")
    absent = F.lit(False)
    for f in "tohlcv":
        absent = absent | F.col(f"b.{f}").isNull()
    fault = (
        F.when(F.col("__fault").isNotNull(), F.col("__fault")).when(F.col("who") != symbol, "other_symbol").when(F.col("b").isNull(), None).when(absent, "missing_field").when(~zoned | ts.isNull(), "naive_timestamp")
        .when(F.pmod(F.unix_micros(ts), F.lit(MINUTE_US)) != 0, "off_grid").when((ts < F.lit(start)) | (ts >= F.lit(end)), "outside_window")
    )
    out = b.withColumn("fault", fault).where(F.col("fault").isNotNull() | F.col("b").isNotNull())
    return out.select(F.lit(symbol).alias("symbol"), ts.alias("timestamp_utc"), *[F.col(f"b.{s}").alias(n) for s, n in zip(("o", "h", "l", "c", "v", "vw", "n"), ("open", "high", "low", "close", "volume", "vwap", "transactions"))], "fault")


def listed_bars(pages: DataFrame, symbol: str, json_col: str = "json") -> DataFrame:
    """Bar pages {status, results: [{t: epoch ms or ISO text, ...}]}. Bars without t are dropped. Faults: not_json, no_status, status, naive_timestamp."""
    p = pages.withColumn("__p", F.from_json(json_col, f"struct<status:string,results:array<{_BAR}>>"))
    status = F.col("__p.status")
    page_fault = F.when(F.get_json_object(json_col, "$").isNull(), "not_json").when(status.isNull(), "no_status").when(~status.isin("OK", "DELAYED"), "status")
    b = p.withColumn("__fault", page_fault).select("__fault", F.explode_outer("__p.results").alias("b"))
    epoch, zoned = F.col("b.t").rlike(r"^\d+(\.\d+)?$"), F.col("b.t").rlike(r"(Z|[+-]\d\d:?\d\d)$")
    ts = F.when(epoch, F.timestamp_millis(F.col("b.t").try_cast("double").cast("long"))).when(zoned, F.try_to_timestamp("b.t"))
    fault = F.when(F.col("__fault").isNotNull(), F.col("__fault")).when(F.col("b.t").isNotNull() & ts.isNull(), "naive_timestamp")
    out = b.withColumn("fault", fault).where(F.col("fault").isNotNull() | F.col("b.t").isNotNull())
    return out.select(F.lit(symbol).alias("symbol"), ts.alias("timestamp_utc"), *[F.col(f"b.{s}").alias(n) for s, n in zip(("o", "h", "l", "c", "v", "vw", "n"), ("open", "high", "low", "close", "volume", "vwap", "transactions"))], "fault")


def require_sound(bars: DataFrame) -> DataFrame:
    """bars without the fault column; reading a row that has a fault fails the job with its name. Lazy, in the same pass."""
    broken = F.raise_error(F.concat(F.lit("bar feed: "), F.col("fault")))
    return bars.withColumn("timestamp_utc", F.when(F.col("fault").isNull(), F.col("timestamp_utc")).otherwise(broken.cast("timestamp"))).drop("fault")


def read_bars(spark: SparkSession, root: str, symbols: Sequence[str], first: dt.date, last: dt.date, expected: dict[str, str] | None = None, unlabelled_source: str | None = None, seen: Observation | None = None) -> DataFrame:
    """Stored bars of symbols, partitioned by symbol and New York year: years outside are pruned, the instants clip the rest (both ends inclusive days).

    expected: what each row of the files read must carry (source, feed, ...). Rows outside the clip are looked at too, in the same scan: the instant that the clip compares is there only for rows of the
    dataset, and any other row fails the job. Tables without provenance columns pass only for unlabelled_source. `seen`, if given, has rows and <column>_faults once an action has run.
    Naive timestamps stay what they are, for the validation to count; the clip takes them for UTC.
    """
    from ..functions.times import date_window

    lo, hi = date_window(first, last)
    b = spark.read.parquet(root)
    years = F.col("year").between(first.year, last.year) if "year" in b.columns else F.lit(True)
    b = b.where(F.col("symbol").isin(*symbols) & years)
    kind = dict(b.dtypes)["timestamp_utc"]
    at = F.col("timestamp_utc")
    if expected:
        if unlabelled_source and expected.get("source") == unlabelled_source and not any(c in b.columns for c in ("feed", "feed_scope")):
            expected = {k: v for k, v in expected.items() if k in b.columns}
        wrong = {c: ~F.col(c).eqNullSafe(v) if c in b.columns else F.lit(True) for c, v in expected.items()}
        if seen is not None:
            b = b.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(w).alias(f"{c}_faults") for c, w in wrong.items()])
        said = F.concat_ws(", ", *[F.when(w, c) for c, w in wrong.items()])
        at = F.when(said == "", at).otherwise(F.raise_error(F.concat(F.lit("a row of another dataset, by "), said)).cast(kind))
    b = b.withColumn("timestamp_utc", at)
    return b.where((F.col("timestamp_utc") >= F.lit(lo).cast(kind)) & (F.col("timestamp_utc") < F.lit(hi).cast(kind)))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Stored events in the engine's schema, NaN as null; an absent path is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MACRO_EVENT)
    e = conform(raw, MACRO_EVENT)
    return e.withColumns({c: present(F.col(c)) for c, t in e.dtypes if t == "double"})


def normalised_bars(raw: DataFrame, symbol: str, identity: dict[str, str], retrieved: Column, now: dt.datetime) -> DataFrame:
    """Raw bars as canonical ones: numbers that are none become null, provenance is added. Naive or off-grid times fail the job."""
    if dict(raw.dtypes)["timestamp_utc"] == "timestamp_ntz":
        raise ValueError("bars have naive timestamps")
    r = conform(raw.withColumns({c: F.col(c).try_cast("double") for c in ("open", "high", "low", "close", "volume", "vwap") if c in raw.columns}), BAR_RAW)
    off = F.pmod(F.unix_micros("timestamp_utc"), F.lit(MINUTE_US)) != 0
    ts = F.when(~off, F.col("timestamp_utc")).otherwise(F.raise_error(F.lit("a bar is off the minute grid")).cast("timestamp"))
    r = r.withColumn("timestamp_utc", ts)
    return r.withColumns({"symbol": F.lit(symbol), **{k: F.lit(v) for k, v in identity.items()}, "retrieval_timestamp_utc": retrieved, "normalized_at_utc": F.lit(now).cast("timestamp")})


def known_datasets(spark: SparkSession, root: str, known: Sequence[str]) -> tuple[list[str], list[str]]:
    """Feeds stored below root (folders feed=...), and folders that no known feed explains. Only the folder is listed; no data is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in listed if f.isDirectory()]
    found = {n.removeprefix("feed=") for n in names if not n.startswith(("_", "."))}
    return sorted(found & set(known)), sorted(found - set(known))


def fetched(pages: Callable[[str | None], tuple[object, str | None]], most: int = 10_000) -> list[object]:
    """All pages behind a token or next-url protocol; a repeated token or too many pages is an error. The seam for live sources."""
    out, token, seen = [], None, set()
    for _ in range(most):
        page, token = pages(token)
        out.append(page)
        if token is None:
            return out
        if token in seen:
            raise RuntimeError(f"the page token {token!r} came again")
        seen.add(token)
    raise RuntimeError("too many pages")
