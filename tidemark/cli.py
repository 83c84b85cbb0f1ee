"""Entry points: `python -m tidemark.cli COMMAND ...`. Tables come in and go out as Parquet, small reports as CSV and JSON.

Exit codes: 0 done; 1 the data failed the command's check; 2 bad arguments. Messages are redacted.
"""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import json
import sys
from collections.abc import Callable, Sequence
from dataclasses import asdict, replace
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import content_hash, spec_hash
from .functions.secrets import redacted
from .functions.times import chunks, ny_date
from .operators import bars as bar_ops
from .operators import compare, descriptor, reconcile, response
from .operators.claims import after_rewrite, chunk_facts, fetched_status
from .operators.intervals import verified
from .plans.event_study import StudySpec, report, study
from .plans.spec_files import SpecError, load_labels, load_spec
from .schema import BAR_RAW, MANIFEST, conform
from .sources import pages, registry, sessions, snapshots
from .sources.feeds import as_of, import_counts
from .sources.providers import Capabilities
from .sources.versions import VersionedTable
from .store import written
from .streaming.incremental import current, is_provisional, record, to_fetch

Command = Callable[[SparkSession, argparse.Namespace], int]
_COMMANDS: dict[str, tuple[Command, list[tuple[str, dict]]]] = {}


class Bad(ValueError):
    """An argument that can't be used."""


def command(*arguments: tuple[str, dict]) -> Callable[[Command], Command]:
    def register(f: Command) -> Command:
        _COMMANDS[f.__name__.replace("_", "-")] = (f, list(arguments))
        return f

    return register


def need(name: str, **more) -> tuple[str, dict]:
    return f"--{name}", {"required": "default" not in more and more.get("action") is None, **more}


def told(**facts) -> None:
    print(redacted(json.dumps(facts, sort_keys=True, default=str)))


def _registry(spark: SparkSession, path: str | None) -> tuple[DataFrame, str]:
    parsed = registry.parse_registry(json.loads(Path(path).read_text())) if path else []
    return registry.registry_frame(spark, parsed), registry.content_hash(parsed)


def _date(text: str, name: str) -> dt.date:
    try:
        return dt.date.fromisoformat(text)
    except ValueError:
        raise Bad(f"{name} is not a date: {text}") from None


def _span(bars: DataFrame, start: str | None, end: str | None) -> tuple[dt.date, dt.date]:
    """The asked days; where one isn't asked for, the New York date of the first or last bar."""
    first, last = (_date(x, n) if x else None for x, n in ((start, "start"), (end, "end")))
    if first is None or last is None:
        own = bars.agg(ny_date(F.min("timestamp_utc")), ny_date(F.max("timestamp_utc"))).first()
        if own[0] is None:
            raise Bad("there are no bars")
        first, last = first or own[0], last or own[1]
    if first > last:
        raise Bad("start is after end")
    return first, last


def _sessions(spark: SparkSession, bars: DataFrame, days_before: int = 0, start: str | None = None, end: str | None = None) -> DataFrame:
    """Sessions of the span, and of some days before it."""
    first, last = _span(bars, start, end)
    return sessions.session_frame(spark, first - dt.timedelta(days_before), last)


def _us(bars: DataFrame) -> DataFrame:
    return bars.withColumn("bar_us", F.unix_micros(F.col("timestamp_utc").cast("timestamp")))


def _as_slots(days: DataFrame) -> DataFrame:
    return days.select(F.col("ny_date").alias("session"), F.unix_micros("open").alias("open_us"), F.unix_micros("close").alias("close_us"))


def _slots(spark: SparkSession, bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return _as_slots(_sessions(spark, bars, 0, start, end))


def _instant(text: str | None) -> dt.datetime:
    """An instant with a zone; now, if none is told."""
    if not text:
        return dt.datetime.now(dt.timezone.utc)
    try:
        at = dt.datetime.fromisoformat(text)
    except ValueError:
        raise Bad(f"not an instant: {text}") from None
    if at.tzinfo is None:
        raise Bad(f"{text} has no time zone")
    return at


def _micros(at: dt.datetime) -> int:
    return int((at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any of Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _row_sum(df: DataFrame) -> list:
    """Expressions whose values are those of the rows, in any order."""
    every = [F.to_json(c) if t.startswith(("map", "variant")) else F.col(c) for c, t in sorted(df.dtypes)]
    return [F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*every).cast("decimal(38,0)")).alias("sum")]


def _checked_write(df: DataFrame, path: str, key: list[str]) -> dict | None:
    """Writes df and reads it back: its rows and hash, or None if other rows come back than went in. The plan runs once; what went in is observed on the way."""
    seen = Observation()
    df.observe(seen, *_row_sum(df)).write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    found = back.agg(*_row_sum(back)).first().asDict()
    return {"path": path, "rows": found["rows"], "content_sha256": content_hash(back, key), "key": key} if found == seen.get else None


def _reports(tables: dict[str, DataFrame], folder: Path) -> dict[str, dict]:
    """Small tables as CSV, and an inventory of them. Files that the last inventory names and this run doesn't make go; others' files stay. Returns rows and checksums."""
    folder.mkdir(parents=True, exist_ok=True)
    ledger = folder / "inventory.json"
    mine = set(json.loads(ledger.read_text())) if ledger.exists() else set()
    out = {}
    for name, df in sorted(tables.items()):
        frame, path = df.toPandas(), folder / f"report_{name}.csv"  # a row for each family, symbol and bin or so
        frame.to_csv(path, index=False)
        out[path.name] = {"rows": len(frame), "sha256": snapshots.file_checksum(str(path))}
    for stale in mine - set(out):
        (folder / stale).unlink(missing_ok=True)
    ledger.write_text(json.dumps(out, indent=1, sort_keys=True))
    return out


@command(need("calendar"), need("bars"), need("symbols"), need("out"), need("registry", default=None), need("descriptor", default=None), need("official", default=None), need("research-end", default=None), need("spec", default=None))
def build_event_response_dataset(spark: SparkSession, a: argparse.Namespace) -> int:
    """The study's tables, hashed before writing and after reading back; reports; a JSON of all inputs and outputs."""
    bars, symbols = spark.read.parquet(a.bars), [s.strip() for s in a.symbols.split(",") if s.strip()]
    entries, entries_hash = _registry(spark, a.registry)
    identity = None
    if a.descriptor:
        committed = spark.read.parquet(a.descriptor)
        found = descriptor.differences(committed, descriptor.descriptor(_us(bars), _slots(spark, bars), 60_000_000, registry=entries)).limit(20).collect()
        if found:
            told(error="the bars are not those of the descriptor", differences=[r.asDict() for r in found])
            return 1
        identity = descriptor.fingerprint_of(committed)
    try:
        spec = load_spec(spark, a.spec) if a.spec else StudySpec()
    except SpecError as fault:
        raise Bad(str(fault)) from None
    if a.research_end:
        spec = replace(spec, research_end=a.research_end)
    events, wide, windows = study(spark.read.parquet(a.calendar), bars, _sessions(spark, bars, 120), entries, symbols, spec, spark.read.parquet(a.official) if a.official else None)
    outputs = {}
    for name, df, key in (("event_response", wide, ["event_id", "symbol"]), ("event_response_windows", windows, ["release_id", "symbol", "window"])):
        outputs[name] = _checked_write(df, f"{a.out}/{name}", key)
        if outputs[name] is None:
            told(error=f"{name} changed on its way through the files")
            return 1
    wide, windows = (spark.read.parquet(f"{a.out}/{n}") for n in ("event_response", "event_response_windows"))
    tables = report(wide, windows, spec)
    if a.official:
        tables["official"] = reconcile.official_summary(wide.dropDuplicates(["event_id"]))
    inventory = _reports(tables, Path(a.out) / "reports")
    facts = {"market_fingerprint": identity, "registry_sha256": entries_hash, "spec_sha256": spec_hash(asdict(spec)), "outputs": outputs, "reports": inventory}
    (Path(a.out) / "dataset.json").write_text(json.dumps(facts, indent=1, sort_keys=True, default=str))
    told(**{n: o["rows"] for n, o in outputs.items()})
    return 0


@command(need("releases"), need("bars"), need("out"), need("source", default=None), need("feed", default=None))
def build_macro_market_response(spark: SparkSession, a: argparse.Namespace) -> int:
    """Feature rows of reconciled releases; bars of another dataset fail."""
    bars = spark.read.parquet(a.bars)
    try:
        bar_ops.require_provenance(bars, {k: v for k, v in (("source", a.source), ("feed", a.feed)) if v})
    except ValueError as fault:
        told(error=str(fault))
        return 1
    made = _checked_write(response.market_response(spark.read.parquet(a.releases), bars), a.out, ["release_id", "symbol"])
    told(**(made or {"error": "the rows changed on their way through the files"}))
    return 0 if made else 1


@command(need("bars"), need("out"), need("registry", default=None), need("sparse", action="store_true"), need("check", action="store_true"), need("start", default=None), need("end", default=None))
def build_dataset_descriptor(spark: SparkSession, a: argparse.Namespace) -> int:
    """Writes the descriptor, or with --check compares it with what is stored: 1 if they differ, 2 if there is none."""
    bars = spark.read.parquet(a.bars)
    now = descriptor.descriptor(_us(bars), _slots(spark, bars, a.start, a.end), 60_000_000, registry=_registry(spark, a.registry)[0], sparse=a.sparse)
    if not a.check:
        now.write.mode("overwrite").parquet(a.out)
        told(fingerprint=descriptor.fingerprint_of(spark.read.parquet(a.out)))
        return 0
    if not _there(spark, a.out):
        raise Bad(f"there is no descriptor at {a.out}")
    found = [r.asDict() for r in descriptor.differences(spark.read.parquet(a.out), now).limit(20).collect()]
    told(differences=found)
    return 1 if found else 0


@command(need("bars"), need("registry", default=None), need("sparse", action="store_true"), need("start", default=None), need("end", default=None), need("as-of", default=None), need("symbols", default=None))
def validate_data(spark: SparkSession, a: argparse.Namespace) -> int:
    """The validation report of each symbol over the asked days, as of an instant (now); 1 on a hard failure only. Sessions without any bar count, at the span's ends and for symbols without bars too."""
    stored = spark.read.parquet(a.bars)
    naive = bar_ops.is_naive(stored, "timestamp_utc")
    first, last = _span(stored.withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp")), a.start, a.end)
    inside = ny_date(F.col("timestamp_utc").cast("timestamp")).between(F.lit(first), F.lit(last))
    bars = _us(stored.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")).where(inside))
    symbols = spark.createDataFrame([(s.strip(),) for s in a.symbols.split(",") if s.strip()], "symbol string") if a.symbols else bars.select("symbol").distinct()
    days = _as_slots(sessions.session_frame(spark, first, last))
    slots = bar_ops.slot_coverage(bars, days, ["symbol"], 60_000_000, _micros(_instant(a.as_of)), registry=_registry(spark, a.registry)[0], groups=symbols)
    late = bar_ops.out_of_order(bars, ["symbol", "__file"], "__row").groupBy("symbol").agg(F.sum("unsorted_rows").alias("unsorted_rows"))
    defects = symbols.join(bar_ops.integrity(bars, ["symbol"]), "symbol", "left").join(late, "symbol", "left").withColumn("naive_timestamp_count", F.col("total_rows") if naive else F.lit(0))
    rows = bar_ops.validation_report(defects, slots, ["symbol"], a.sparse)
    bad = [r.asDict() for r in rows.where("is_hard_failure").collect()]
    told(start=first, end=last, failed=bad)
    return 1 if bad else 0


@command(need("calendars"), need("official"), need("start"), need("end"), need("out"), need("trust-timezone", action="store_true"), need("strict", action="store_true"))
def validate_macro_events(spark: SparkSession, a: argparse.Namespace) -> int:
    """The reconciliation of calendars in a window; with --strict 1 unless every release is a MATCH."""
    if a.start > a.end:
        raise Bad("start is after end")
    calendars = spark.read.parquet(a.calendars)
    reconcile.release_table(calendars, spark.read.parquet(a.official), a.start, a.end, timezone_trusted=a.trust_timezone).write.mode("overwrite").parquet(a.out)
    counts = {r[0]: r[1] for r in spark.read.parquet(a.out).groupBy("source_match_status").count().collect()}
    told(statuses=counts, undated={r[0]: r[1] for r in reconcile.undated(calendars, a.start, a.end).collect()})
    return 1 if a.strict and set(counts) - {"MATCH"} else 0


@command(need("a"), need("b"), need("out"), need("side-a"), need("side-b"))
def compare_market_providers(spark: SparkSession, a: argparse.Namespace) -> int:
    """Reports of two vendors' bars. Sides: label/source/feed/scope/adjustment/timeframe. 2 if they can't be compared, 1 without common bars."""
    try:
        left, right = (compare.Side(*told_side.split("/")) for told_side in (a.side_a, a.side_b))
        volumes = compare.check_compatible(left, right)
    except (TypeError, compare.Incompatible) as fault:
        raise Bad(str(fault)) from None
    pairs = compare.matched(_us(spark.read.parquet(a.a)), _us(spark.read.parquet(a.b)))
    tables = {"coverage": compare.coverage(pairs), "prices": compare.price_stats(pairs), "correlation": compare.return_correlation(compare.return_pairs(pairs, 60_000_000)), "largest": compare.largest_differences(pairs)}
    if volumes:
        tables["volume"] = compare.volume_stats(pairs)
    told(reports=_reports(tables, Path(a.out)))
    return 0 if pairs.where("in_a and in_b").take(1) else 1


@command(need("pages"), need("mapping"), need("year", type=int), need("out"), need("currency", default="USD"), need("zone", default=None))
def import_forex_factory(spark: SparkSession, a: argparse.Namespace) -> int:
    """Saved calendar pages (page_id, html) as events; 1 if no page gives a row."""
    try:
        mapping = load_labels(spark, a.mapping).withColumnRenamed("label_key", "name") if a.mapping.endswith((".json", ".yaml", ".yml")) else spark.read.parquet(a.mapping)
    except SpecError as fault:
        raise Bad(str(fault)) from None
    rows = pages.calendar(spark.read.parquet(a.pages))
    pages.event_rows(rows, mapping, a.year, a.currency, a.zone).write.mode("overwrite").parquet(a.out)
    counts = import_counts(rows, mapping).first().asDict()
    told(**counts)
    return 0 if counts["rows"] else 1


@command(need("vintages"), need("day"), need("out"))
def fetch_fred_asof(spark: SparkSession, a: argparse.Namespace) -> int:
    """An official series as it was on a day, as a verified snapshot."""
    taken = dt.datetime.now(dt.timezone.utc)
    name = snapshots.save_snapshot(as_of(spark.read.parquet(a.vintages), dt.date.fromisoformat(a.day)), a.out, ["series_id", "date"], taken)
    told(snapshot=name)
    return 0 if name else 1


def stored_bars(spark: SparkSession, out: str) -> VersionedTable:
    """The bars that fetch-historical-data and update-data keep below out."""
    return VersionedTable(spark, f"{out}/bars", f"symbol string, year int, {BAR_RAW}", ["symbol", "year"])


def _claims(manifest: DataFrame) -> DataFrame:
    return manifest.select("*", F.col("key").alias("symbol"), F.concat_ws("/", F.col("start").cast("string"), F.col("end").cast("string")).alias("claim"))


def _fetch(spark: SparkSession, a: argparse.Namespace, months: DataFrame, overlap: int) -> int:
    """Chunks that are not yet verified, one by one, from a provider: an object with fetch(spark, key, start, end) -> bars, and perhaps `capabilities`.

    A chunk's status is what its stored rows earn over its days, as of the fetch: never complete for being there. Rows are kept whatever they earn. Other chunks in rewritten partitions are judged again, each as of its own fetch.
    """
    module, _, name = a.provider.partition(":")
    provider = getattr(importlib.import_module(module), name or "provider")()
    able = getattr(provider, "capabilities", Capabilities(provider=module))
    table, today, at = stored_bars(spark, a.out), _date(a.today, "today"), f"{a.out}/manifest"
    manifest = current(spark, at) if _there(spark, at) else None
    wanted = months if manifest is None else to_fetch(months, manifest, today, overlap)
    entries, _ = _registry(spark, a.registry)
    how = {"sparse": able.bar_density == "sparse", "registry": entries, "provider": able.provider, "feed": able.feed}
    now = dt.datetime.combine(today + dt.timedelta(1), dt.time(), dt.timezone.utc)
    failed, rewritten = 0, []
    for c in wanted.orderBy("key", "start").collect():  # months of a few symbols
        error, n, status, path, version = None, 0, "failed", None, None
        try:
            new = conform(provider.fetch(spark, c["key"], c["start"], c["end"]), BAR_RAW).withColumns({"symbol": F.lit(c["key"]), "year": F.year("timestamp_utc")})
            version = table.upsert(new, ["symbol", "timestamp_utc"], {"chunk": f"{c['key']} {c['start']} {c['end']}"})
            path = f"{c['key']}/{c['start'].year}"
            rewritten.append((path, str(version)))
            asked = spark.createDataFrame([(c["key"], "now", c["start"], c["end"], _micros(now))], "symbol string, claim string, start date, end date, as_of_us long")
            held = _us(table.read(version).where((F.col("symbol") == c["key"]) & F.col("year").between(c["start"].year, c["end"].year)))
            judged = fetched_status(chunk_facts(asked, held, _as_slots(sessions.session_frame(spark, c["start"], c["end"])), **how), is_provisional(F.col("end"), today, overlap)).first()
            status, n, error = judged["status"], judged["stored_rows"], judged["error"]
        except Exception as fault:  # noqa: BLE001  a source's own errors are of any class; they are recorded
            error = redacted(fault)
        failed += status == "failed"
        row = [(module, c["key"], status, None if version is None else str(version), path, error, c["start"], c["end"], n, min(now, dt.datetime.now(dt.timezone.utc)), dt.datetime.now(dt.timezone.utc), None, None)]
        record(at, spark.createDataFrame(row, MANIFEST))
    if rewritten:
        kept = _claims(current(spark, at))
        last = spark.createDataFrame(list(dict(rewritten).items()), "path string, checksum string")
        span = kept.agg(F.min("start"), F.max("end")).first()
        again = after_rewrite(kept, last, _us(table.read()), _as_slots(sessions.session_frame(spark, span[0], span[1])), dt.datetime.now(dt.timezone.utc), **how)
        again = written(conform(again, MANIFEST), "siblings")
        failed += again.where("status = 'failed'").count()
        record(at, again)
    told(failed=failed)
    return 1 if failed else 0


def _chunks(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    first, last = dt.date.fromisoformat(a.start), dt.date.fromisoformat(a.today)
    if first > last:
        raise Bad("start is after today")
    keys = spark.createDataFrame([(s.strip(),) for s in a.symbols.split(",") if s.strip()], "key string")
    return keys.crossJoin(chunks(spark, first, last))  # a few symbols times the months


@command(need("provider"), need("symbols"), need("start"), need("today"), need("out"), need("registry", default=None))
def fetch_historical_data(spark: SparkSession, a: argparse.Namespace) -> int:
    """All months that are not there and verified; 1 if any failed."""
    return _fetch(spark, a, _chunks(spark, a), 0)


@command(need("provider"), need("symbols"), need("start"), need("today"), need("out"), need("registry", default=None), need("overlap-days", type=int, default=5))
def update_data(spark: SparkSession, a: argparse.Namespace) -> int:
    """As fetch-historical-data, with the trailing days once more; 1 on failures or if a month before them stays open."""
    code, every = _fetch(spark, a, _chunks(spark, a), a.overlap_days), _chunks(spark, a)
    done = verified(current(spark, f"{a.out}/manifest")).select("key", "start", "end")
    old = every.where(F.col("end") < F.lit(dt.date.fromisoformat(a.today) - dt.timedelta(a.overlap_days)))
    return 1 if code or old.join(done, ["key", "start", "end"], "left_anti").take(1) else 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    kinds = parser.add_subparsers(dest="command", required=True)
    for name, (f, arguments) in _COMMANDS.items():
        sub = kinds.add_parser(name, help=f.__doc__)
        for flag, more in arguments:
            sub.add_argument(flag, **({k: v for k, v in more.items() if k != "required"} if more.get("action") else more))
    try:
        a = parser.parse_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0)
    if spark is None:
        from .session import local_session

        spark = local_session()
    try:
        return _COMMANDS[a.command][0](spark, a)
    except Bad as fault:
        told(error=str(fault))
        return 2


if __name__ == "__main__":
    sys.exit(main())
