"""Calendar pages: charset, the table as rendered, the states embedded as JSON.

HTML needs a parser, so pages run through Python in Arrow batches; what follows (carrying dates down, values, units, times) is
expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import parse_value
from ..functions.times import long, prior_month, time_of_day
from ..store import written

#: Marks in the classes of an impact's span, in the order in which they are looked for, and what they say.
IMPACTS = (("red", "HIGH"), ("ora", "MEDIUM"), ("yel", "LOW"), ("gra", "NONE"), ("grey", "NONE"))
_STATES = re.compile(r"calendarComponentStates\[\s*\d+\s*\]\s*=\s*\{\s*days\s*:\s*(?=\[)")
_ZONE = re.compile(r"timezone_?name[\"']?\s*[:=]\s*[\"']([A-Za-z_]+/[A-Za-z_/+\-0-9]+)[\"']", re.IGNORECASE)
#: Bytes of a page in which its charset is declared.
HEAD = 2048
#: Table rows that a Python worker holds before it hands them on, about (whole pages or parts).
HELD_ROWS = 5000


class _Charset(HTMLParser):
    """The charset of the first meta tag that declares one, by attribute or in its content."""

    def __init__(self) -> None:
        super().__init__()
        self.found: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "meta" and not self.found:
            told = dict(attrs)
            content = (told.get("content") or "").lower().partition("charset=")[2]
            self.found = (told.get("charset") or content.partition(";")[0]).strip("\"' ") or None


def declared_charset(data: bytes) -> str | None:
    parser = _Charset()
    parser.feed(data[:HEAD].decode("latin-1"))
    return parser.found


def decode(data: bytes) -> str:
    """Strictly: the declared charset, UTF-8, cp1252, Latin-1; the first that fits."""
    for name in (declared_charset(data), "utf-8", "cp1252", "latin-1"):
        if name:
            try:
                return data.decode(name)
            except (UnicodeDecodeError, LookupError):
                continue
    raise AssertionError("Latin-1 decodes anything")


class _Rows(HTMLParser):
    """Cells of table rows: text, own classes, and the classes of the spans inside."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, str, str]]] = []
        self.attrs: list[str] = []
        self._text: list[str] | None = None
        self._class = ""
        self._spans: list[str] = []
        self._skip = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        classes = dict(attrs).get("class") or ""
        if tag in ("script", "style"):
            self._skip += 1
        elif tag == "tr":
            self._close()
            self.rows.append([])
            self.attrs.append(json.dumps({k: v for k, v in attrs}))
        elif tag in ("td", "th"):
            self._close()
            if self.rows:
                self._text, self._class, self._spans = [], classes, []
        elif tag == "span" and classes:
            self._spans.append(classes)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self._skip = max(0, self._skip - 1)
        elif tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data: str) -> None:
        if self._text is not None and not self._skip:
            self._text.append(data)

    def _close(self) -> None:
        if self._text is not None:
            self.rows[-1].append((" ".join("".join(self._text).split()), self._class, " ".join(self._spans)))
            self._text = None


def table_rows(html: str) -> list[tuple[list[str], list[str], list[str], str]]:
    """(texts, classes, span classes, row attributes) of each table row that has cells."""
    p = _Rows()
    p.feed(html)
    p.close()
    return [(*map(list, zip(*r)), a) for r, a in zip(p.rows, p.attrs) if r]


def scan_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", part_col: str | None = None) -> DataFrame:
    """id, (part,) row_no, cells, classes, spans, attrs of every table row of every page, or of every part of a page. row_no counts within a page or part."""
    keys = [id_col, *([part_col] if part_col else [])]
    names = [*keys, "row_no", "cells", "classes", "spans", "attrs"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for *key, html in frame.itertuples(index=False, name=None):
                out += [(*key, n, *row) for n, row in enumerate(table_rows(html or ""))]
                if len(out) >= HELD_ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    rows = pages.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(html_col).alias("__html"))
    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(run, f"{kinds}, row_no int, cells array<string>, classes array<string>, spans array<string>, attrs string")


def page_facts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, charset, n_rows, n_cells, n_links, title: what a page declares and holds, by expressions only."""
    h = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(
        id_col, F.lower(F.regexp_extract(F.substring(h, 1, 2048), r"(?i)<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-]+)", 1)).alias("charset"), F.regexp_count(h, F.lit(r"(?i)<tr[\s>]")).cast("long").alias("n_rows"),
        F.regexp_count(h, F.lit(r"(?i)<t[dh][\s>]")).cast("long").alias("n_cells"), F.regexp_count(h, F.lit(r"(?i)<a\s")).cast("long").alias("n_links"), F.regexp_extract(h, r"(?is)<title>(.*?)</title>", 1).alias("title"),
    )


def impact(classes: Column) -> Column:
    """What the first class with a known mark says, by the order of marks within it; NONE without any."""
    told = F.transform(F.split(F.coalesce(classes, F.lit("")), r"\s+"), _mark)
    return F.coalesce(F.get(F.filter(told, lambda t: t.isNotNull()), 0), F.lit("NONE"))


def _mark(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for mark, said in reversed(IMPACTS):
        out = F.when(name.contains(mark), said).otherwise(out)
    return out


def _place(name: str) -> Column:
    """The index of the first cell whose class names the field, or null."""
    at = F.array_position(F.transform("classes", lambda c: F.array_contains(F.split(c, r"\s+"), f"calendar__{name}")), True)
    return F.when(at > 0, at.cast("int") - 1)


def _cell(name: str) -> Column:
    return F.get("cells", _place(name))


def calendar_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", part_col: str | None = None) -> DataFrame:
    """The calendar table: id, row_no, day_text, time_text, currency, impact, name, actual, forecast, previous.

    Dates and times stand once and hold until the next; rows before any date are dropped. Carrying down is last(ignore nulls) within a page. A page that is too large for one value comes in parts
    (part_col: their order; each with whole table rows): row_no counts on from part to part, and dates and times hold on, so a page of any size spreads over tasks.
    """
    rows = scan_tables(pages, id_col, html_col, part_col)
    texts = {n: F.nullif(F.trim(_cell(c)), F.lit("")) for n, c in (("day_text", "date"), ("time_text", "time"), ("currency", "currency"), ("name", "event"), ("actual", "actual"), ("forecast", "forecast"), ("previous", "previous"))}
    rows = rows.withColumns(texts).withColumn("impact", impact(F.get("spans", _place("impact")))).drop("cells", "classes", "spans", "attrs")
    keys = [id_col, *([part_col] if part_col else [])]
    upto = lambda *by: Window.partitionBy(*by).orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if part_col:
        rows = written(rows, "parts")
        # what the parts before leave behind: a row for each part
        ahead = lambda *by: Window.partitionBy(*by).orderBy(part_col).rowsBetween(Window.unboundedPreceding, -1)
        ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by("day_text", F.when(F.col("day_text").isNotNull(), F.col("row_no"))).alias("day"))
        ends = ends.select(*keys, F.coalesce(F.sum("n").over(ahead(id_col)), F.lit(0)).cast("int").alias("__rows"), F.last("day", ignorenulls=True).over(ahead(id_col)).alias("__held"))
        rows = rows.join(ends, keys).withColumn("__day", F.coalesce(F.last("day_text", ignorenulls=True).over(upto(*keys)), "__held"))
        ends = rows.groupBy(*keys, "__day").agg(F.max_by("time_text", F.when(F.col("time_text").isNotNull(), F.col("row_no"))).alias("time"))
        ends = ends.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__day").alias("__d"), F.last("time", ignorenulls=True).over(ahead(id_col, "__day")).alias("__time"))
        same = F.col("__day") == F.col("__d")
        for i, k in enumerate(keys):
            same = same & (F.col(k) == F.col(f"__k{i}"))
        rows = rows.join(ends, same, "left").withColumn("time_text", F.coalesce(F.last("time_text", ignorenulls=True).over(upto(*keys, "__day")), "__time")).withColumn("row_no", F.col("row_no") + F.col("__rows"))
    else:
        rows = rows.withColumn("__day", F.last("day_text", ignorenulls=True).over(upto(id_col)))
        rows = rows.withColumn("time_text", F.last("time_text", ignorenulls=True).over(upto(id_col, "__day")))
    rows = rows.withColumn("day_text", F.col("__day"))
    return rows.where("day_text is not null and name is not null").select(id_col, "row_no", "day_text", "time_text", "currency", "impact", "name", "actual", "forecast", "previous")


def state_arrays(html: str) -> list[str]:
    """Each embedded `days: [...]` as JSON text; what the decoder can't read is left out."""
    decoder, out = json.JSONDecoder(), []
    for m in _STATES.finditer(html):
        try:
            out.append(html[m.end() : decoder.raw_decode(html, m.end())[1]])
        except ValueError:
            continue
    return out


_EVENT = "struct<id:string,ebaseId:string,name:string,currency:string,impactClass:string,timeLabel:string,timeMasked:boolean,dateline:bigint,date:string,actual:string,forecast:string,previous:string,revision:string>"
_DAYS = f"array<struct<date:string,dateline:bigint,events:array<{_EVENT}>>>"


def _states(html: Column) -> Column:
    @F.pandas_udf("array<string>")
    def found(htmls: pd.Series) -> pd.Series:
        return htmls.map(lambda h: state_arrays(h or ""))

    return found(html)


def calendar_states(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The embedded calendar: a row for each event; of repeated ids the last on the page counts. The event's own date goes before its day's."""
    s = pages.select(F.col(id_col), F.posexplode(_states(F.col(html_col))).alias("block", "json"))
    d = s.select(id_col, "block", F.posexplode(F.from_json("json", _DAYS)).alias("d", "day"))
    e = d.select(id_col, "block", "d", F.col("day.date").alias("day_date"), F.posexplode("day.events").alias("p", "e"))
    at = F.struct("block", "d", "p")
    e = e.select(id_col, at.alias("at"), F.coalesce("e.id", F.concat_ws(":", F.col("block"), F.col("d"), F.col("p"))).alias("id"), F.coalesce("e.date", "day_date").alias("day_text"), F.col("e").alias("event"))
    last = e.groupBy(id_col, "id").agg(F.max_by(F.struct("day_text", "event"), "at").alias("x"), F.max("at").alias("at"))
    v = lambda n: F.col(f"x.event.{n}")
    return last.select(
        id_col, "id", F.col("x.day_text").alias("day_text"), v("timeLabel").alias("time_text"), v("timeMasked").alias("masked"), v("dateline").alias("epoch"), v("currency").alias("currency"), impact(v("impactClass")).alias("impact"), v("name").alias("name"),
        v("actual").alias("actual"), v("forecast").alias("forecast"), v("previous").alias("previous"), v("revision").alias("revision"),
    )


def calendar(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Embedded states where a page has any, else its table."""
    states = calendar_states(pages, id_col, html_col)
    table = calendar_rows(pages, id_col, html_col).join(states.select(id_col).distinct(), id_col, "left_anti")
    return states.unionByName(table.drop("row_no"), allowMissingColumns=True)


def rendered_days(pages: DataFrame, zone: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every day a page shows, those without events too, from the days' instants in a named zone."""
    s = pages.select(F.col(id_col), F.explode(_states(F.col(html_col))).alias("json"))
    d = s.select(id_col, F.explode(F.from_json("json", _DAYS)).alias("day")).where("day.dateline is not null")
    return d.select(id_col, F.to_date(F.from_utc_timestamp(F.timestamp_seconds("day.dateline"), zone)).alias("day")).distinct()


def zone_name(html: Column) -> Column:
    """The page's own zone by name; a bare offset is never used."""
    found = F.regexp_extract(html, "(?i)" + _ZONE.pattern, 1)
    return F.when(found != "", found)


def looks_whole(html: Column, month_text: str) -> Column:
    """A page worth parsing: long enough, with the calendar's marks and month, and no bot check."""
    h = F.lower(html)
    blocked = h.contains("captcha") | h.contains("checking your browser") | h.contains("access denied")
    return (F.length(html) > 500) & h.contains("calendar") & h.contains(month_text.lower()) & ~blocked


def timestamp_quality(epoch: Column, masked: Column, time_text: Column, zone: str | None, attested: bool) -> Column:
    """CONFIRMED by the page's own instant or an attested zone, ASSUMED by one that is not, TENTATIVE without a time, UNRESOLVED without a zone."""
    known = F.lit("UNRESOLVED") if zone is None else F.lit("CONFIRMED" if attested else "ASSUMED")
    return F.when(epoch.isNotNull() & ~F.coalesce(masked, F.lit(False)), "CONFIRMED").when(time_of_day(time_text).isNull(), "TENTATIVE").otherwise(known)


def event_rows(rows: DataFrame, mapping: DataFrame, year: int, currency: str | None = None, zone: str | None = None, attested: bool = False, id_col: str = "page_id") -> DataFrame:
    """Rows of `calendar` as events of the event schema.

    event_id is `ff:` with the page's own id, or with day, currency, time and name where it has none. Rows of another currency go (rows without
    one stay), and rows whose name, in lower case and without outer blanks, mapping (name, event_family, indicator, release_bundle) doesn't know. Days without a year
    are of `year`. The time is the page's own instant, or day and time on the clock of zone; without either it is null.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    for c, kind in (("id", "string"), ("epoch", "long"), ("masked", "boolean"), ("revision", "string")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    if currency:
        rows = rows.where((text("currency") == "") | (F.upper(text("currency")) == currency.upper()))
    known = mapping.select(F.lower(F.trim("name")).alias("__name"), "event_family", "indicator", "release_bundle")
    e = rows.withColumn("__name", F.lower(text("name"))).join(known, "__name")
    day = F.coalesce(*[F.try_to_timestamp(F.concat_ws(" ", F.regexp_replace(text("day_text"), r"^[A-Za-z]{3} (?=[A-Za-z])", ""), F.lit(str(year))), F.lit(f)) for f in ("MMM d yyyy", "MMMM d yyyy")], F.try_to_timestamp("day_text", F.lit("yyyy-MM-dd"))).cast("date")
    minutes = time_of_day(F.col("time_text"))
    instant = F.when(F.col("epoch").isNotNull() & ~F.coalesce("masked", F.lit(False)), F.timestamp_seconds("epoch"))
    if zone is not None:
        instant = F.coalesce(instant, F.to_utc_timestamp(F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + minutes * long(60_000_000)), zone))
    made = F.concat_ws(":", day.cast("string"), text("currency"), text("time_text"), text("name"))
    numbers = {}
    for field, shown in (("actual", "actual"), ("provider_forecast", "forecast"), ("previous", "previous"), ("revised_previous", "revision")):
        parsed = parse_value(F.col(shown))
        numbers[field] = parsed["value"]
        if field != "revised_previous":
            numbers[f"{field}_unit"], numbers[f"{field}_raw_text"] = parsed["unit"], F.col(shown)
    return e.select(
        id_col, F.concat(F.lit("ff:"), F.coalesce(F.nullif(text("id"), F.lit("")), made)).alias("event_id"), "event_family", "indicator", "release_bundle", day.alias("release_date"),
        prior_month(day).alias("reference_period"), instant.alias("release_timestamp_utc"), timestamp_quality(F.col("epoch"), F.col("masked"), F.col("time_text"), zone, attested).alias("timestamp_quality"),
        *[c.alias(n) for n, c in numbers.items()], F.coalesce("impact", F.lit("NONE")).alias("importance"), F.lit("FOREX_FACTORY").alias("source"),
    )
