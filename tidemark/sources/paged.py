"""Paged vendor bars as a Spark data source: `spark.read.format("paged_bars")` and `spark.readStream.format("paged_bars")`.

A chain is the pages of one symbol and month, each naming the token of the next. A batch read has a task for each chain that the query asks
for: filters on symbol and timestamp_utc, where Spark hands them on (spark.sql.python.filterPushdown.enabled), decide which chains are opened at all. A stream's offset holds the
token of the last page read of each chain, so a restart goes on behind it and replays what was not committed. Tasks hold one page at a time.

Options: path (a recorded store, see below) or transport (module:name of a callable made with the options that gives page(symbol, month, token) -> text or None);
symbols (comma-separated), start and end (first and last day). A page is {"bars": {SYMBOL: [{t, o, h, l, c, v, vw, n}, ...]}, "next_page_token": TOKEN or null}.

A recorded store is what Spark writes with partitionBy("symbol", "month", "token") as text, one page a folder; the first page's token is `first`. Only this
module's driver and tasks read it, by any file system that pyarrow knows.

A page that is no page, a bar of another symbol, an incomplete or naive or off-grid bar, a token that comes twice or, in a batch, a page that is not there fails the job.
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

FIRST = "first"
UTC = dt.timezone.utc
SCHEMA = "symbol string, timestamp_utc timestamp, open double, high double, low double, close double, volume double, vwap double, transactions long"
_ARROW = pa.schema([("symbol", pa.string()), ("timestamp_utc", pa.timestamp("us", "UTC")), *((c, pa.float64()) for c in ("open", "high", "low", "close", "volume", "vwap")), ("transactions", pa.int64())])
#: A bar's fields on the wire; the last two may be absent.
_FIELDS, _OPTIONAL = ("t", "o", "h", "l", "c", "v"), ("vw", "n")

Page = Callable[[str, str, str], str | None]


class FeedError(RuntimeError):
    """The feed breaks its contract."""


def recorded(options: dict[str, str]) -> Page:
    """Pages of a recorded store."""
    files, root = pafs.FileSystem.from_uri(options["path"] if "://" in options["path"] or options["path"].startswith("file:") else f"file://{options['path']}")

    def page(symbol: str, month: str, token: str) -> str | None:
        found = files.get_file_info(pafs.FileSelector(f"{root}/symbol={symbol}/month={month}/token={token}", allow_not_found=True))
        parts = [f for f in found if f.is_file and not f.base_name.startswith(("_", "."))]
        if not parts:
            return None
        if len(parts) > 1:
            raise FeedError(f"{len(parts)} files for one page of {symbol} {month}")
        with files.open_input_stream(parts[0].path) as f:
            return f.read().decode()

    return page


def transport(options: dict[str, str]) -> Page:
    if "transport" not in options:
        return recorded(options)
    module, _, name = options["transport"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


def months(first: dt.date, last: dt.date) -> list[str]:
    out, at = [], first.replace(day=1)
    while at <= last:
        out.append(f"{at:%Y-%m}")
        at = (at + dt.timedelta(32)).replace(day=1)
    return out


def parsed(text: str, symbol: str) -> tuple[list[dict], str | None]:
    """A page's bars and the next token."""
    try:
        page = json.loads(text)
    except ValueError:
        raise FeedError(f"{symbol}: a page is not JSON") from None
    if not isinstance(page, dict) or "bars" not in page:
        raise FeedError(f"{symbol}: a page has no bars field")
    lists = page["bars"] or {}
    if set(lists) - {symbol}:
        raise FeedError(f"{symbol}: a page has bars of another symbol")
    return lists.get(symbol) or [], page.get("next_page_token") or None


def _batch(bars: list[dict], symbol: str) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(len(_FIELDS) + len(_OPTIONAL))]
    for bar in bars:
        if any(bar.get(f) is None for f in _FIELDS):
            raise FeedError(f"{symbol}: a bar lacks a field")
        at = dt.datetime.fromisoformat(bar["t"])
        if at.tzinfo is None:
            raise FeedError(f"{symbol}: a bar has a naive timestamp")
        if at.second or at.microsecond:
            raise FeedError(f"{symbol}: a bar is off the minute grid")
        for column, value in zip(columns, (at.astimezone(UTC), *(float(bar[f]) for f in _FIELDS[1:]), bar.get("vw"), bar.get("n")), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array([symbol] * len(bars), pa.string()), *(pa.array(c, t) for c, t in zip(columns, _ARROW.types[1:], strict=True))], schema=_ARROW)


@dataclass
class Chain(InputPartition):
    symbol: str
    month: str
    #: Pages after this one (None: from the first) up to this one (None: to the end of the chain).
    after: str | None = None
    upto: str | None = None


def _read(options: dict[str, str], chain: Chain) -> Iterator[pa.RecordBatch]:
    page, seen = transport(options), set()
    token: str | None = FIRST
    if chain.after is not None:
        text = page(chain.symbol, chain.month, chain.after)
        if text is None:
            raise FeedError(f"{chain.symbol} {chain.month}: page {chain.after!r} is gone")
        seen.add(chain.after)
        token = parsed(text, chain.symbol)[1]
    while token is not None:
        if token in seen:
            raise FeedError(f"{chain.symbol} {chain.month}: the page token {token!r} came again")
        seen.add(token)
        text = page(chain.symbol, chain.month, token)
        if text is None:
            if token == FIRST:  # the vendor has nothing for the month
                return
            raise FeedError(f"{chain.symbol} {chain.month}: page {token!r} is not there")
        bars, following = parsed(text, chain.symbol)
        if bars:
            yield _batch(bars, chain.symbol)
        token = None if token == chain.upto else following


def _day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def _chains(options: dict[str, str]) -> tuple[list[str], list[str]]:
    try:
        return [s.strip() for s in options["symbols"].split(",") if s.strip()], months(_day(options["start"]), _day(options["end"]))
    except KeyError as absent:
        raise ValueError(f"paged_bars needs the option {absent}") from None


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.symbols, self.months = _chains(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Symbols are cut here for good; times only to months, so Spark filters them again."""
        for f in filters:
            match f:
                case EqualTo(("symbol",), value):
                    self.symbols = [s for s in self.symbols if s == value]
                case In(("symbol",), values):
                    self.symbols = [s for s in self.symbols if s in values]
                case EqualTo(("timestamp_utc",), at):
                    self._between(at, at)
                    yield f
                case GreaterThan(("timestamp_utc",), at) | GreaterThanOrEqual(("timestamp_utc",), at):
                    self._between(at, None)
                    yield f
                case LessThan(("timestamp_utc",), at) | LessThanOrEqual(("timestamp_utc",), at):
                    self._between(None, at)
                    yield f
                case _:
                    yield f

    def _between(self, low: dt.datetime | None, high: dt.datetime | None) -> None:
        """Months are the vendor's, in UTC; a day's slack on both sides covers the zone of the values handed on."""
        slack = dt.timedelta(1)
        self.months = [m for m in self.months if (low is None or m >= f"{low - slack:%Y-%m}") and (high is None or m <= f"{high + slack:%Y-%m}")]

    def partitions(self) -> list[Chain]:
        return [Chain(s, m) for s in self.symbols for m in self.months] or [Chain("", "")]

    def read(self, chain: Chain) -> Iterator[pa.RecordBatch]:
        return _read(self.options, chain) if chain.symbol else iter(())


class PagedStreamReader(DataSourceStreamReader):
    """Offsets: {"SYMBOL month": token of the last page read}; a chain without pages yet is absent."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.symbols, self.months = _chains(options)
        self.page = transport(options)
        self.reached: dict[str, str] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Walks on from where the last walk ended: only new pages are looked at, and of those only the tokens are kept."""
        for symbol in self.symbols:
            for month in self.months:
                key, seen = f"{symbol} {month}", set()
                token = self.reached.get(key)
                token = FIRST if token is None else self._next(symbol, month, token)
                while token is not None and self.page(symbol, month, token) is not None:
                    if token in seen:
                        raise FeedError(f"{symbol} {month}: the page token {token!r} came again")
                    seen.add(token)
                    self.reached[key] = token
                    token = self._next(symbol, month, token)
        return dict(self.reached)

    def _next(self, symbol: str, month: str, token: str) -> str | None:
        text = self.page(symbol, month, token)
        return parsed(text, symbol)[1] if text is not None else None

    def partitions(self, start: dict, end: dict) -> list[Chain]:
        return [Chain(*key.split(" "), start.get(key), token) for key, token in sorted(end.items()) if start.get(key) != token]

    def commit(self, end: dict) -> None:
        """Pages stay where they are; nothing to let go of."""

    def read(self, chain: Chain) -> Iterator[pa.RecordBatch]:
        return _read(self.options, chain)


class PagedBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:  # noqa: ANN001
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> PagedStreamReader:  # noqa: ANN001
        return PagedStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark hand filters on to it."""
    spark.dataSource.register(PagedBars)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def paged_bars(spark: SparkSession, symbols: list[str], start: dt.date, end: dt.date, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("paged_bars").options(symbols=",".join(symbols), start=start.isoformat(), end=end.isoformat(), **options).load()


def record_pages(bars: DataFrame, path: str, per_page: int, mode: str = "append") -> None:
    """Bars (symbol, timestamp_utc, prices, volume, vwap, transactions) as a recorded store, per_page of them on a page by time. Chains are dealt over tasks; each is a month of one symbol."""
    from pyspark.sql import Window

    month = F.date_format("timestamp_utc", "yyyy-MM")
    n = F.row_number().over(Window.partitionBy("symbol", "month").orderBy("timestamp_utc")) - 1
    wire = F.struct(F.date_format("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), *(F.col(c).alias(f) for f, c in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"), ("vw", "vwap"), ("n", "transactions"))))
    token = lambda k: F.when(k == 0, FIRST).otherwise(F.concat(F.lit("p"), k.cast("string")))
    numbered = bars.withColumn("month", month).withColumn("__page", F.floor(n / per_page).cast("int"))
    pages = numbered.groupBy("symbol", "month", "__page").agg(F.transform(F.array_sort(F.collect_list(F.struct("timestamp_utc", wire.alias("b")))), lambda x: x["b"]).alias("list"))
    last = pages.groupBy("symbol", "month").agg(F.max("__page").alias("__last"))
    pages = pages.join(last, ["symbol", "month"])
    body = F.to_json(F.struct(F.create_map("symbol", "list").alias("bars"), F.when(F.col("__page") < F.col("__last"), token(F.col("__page") + 1)).alias("next_page_token")))
    pages.select(body.alias("value"), "symbol", "month", token(F.col("__page")).alias("token")).repartition("symbol", "month").write.mode(mode).partitionBy("symbol", "month", "token").text(path)
