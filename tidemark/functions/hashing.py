"""Content identity that does not depend on row order, file format or storage resolution."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
FIELD_SEPARATOR = "\x1f"


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a, as a signed long."""
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


def fnv1a_column(text: Column) -> Column:
    """fnv1a of a text column, in Arrow batches."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fnv1a(t.encode()))

    return hashed(text)


def window_digest(rows: DataFrame, by: Sequence[str], id_col: str, fields: Sequence[str], position: str) -> DataFrame:
    """by, digest (hex), n: the exclusive or of the rows' hashes after dropping all but the last row of each id. Any order of rows gives the same."""
    last = rows.groupBy(*by, id_col).agg(F.max_by(F.struct(*fields), position).alias("__r"))
    line = F.array_join(F.array(*[F.coalesce(F.col(f"__r.{f}").cast("string"), F.lit("")) for f in fields]), FIELD_SEPARATOR)
    hashed = last.select(*by, fnv1a_column(line).alias("__h"))
    return hashed.groupBy(*by).agg(F.lower(F.lpad(F.hex(F.bit_xor("__h")), 16, "0")).alias("digest"), F.count("*").alias("n"))


def canonical(value: object) -> object:
    """One rendering for each value: missing is null, whole floats below 2^53 are integers, other floats have 17 digits, instants are UTC."""
    if value is None or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return int(value) if value.is_integer() and abs(value) < 2**53 else f"{value:.17g}"
    if isinstance(value, dt.datetime):
        return "naive:" + value.isoformat() if value.tzinfo is None else value.astimezone(dt.timezone.utc).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    if isinstance(value, dict):
        return {str(k): canonical(v) for k, v in value.items()}
    return value if isinstance(value, (int, str)) else str(value)


def _plain(df: DataFrame) -> DataFrame:
    """df with columns in name order, in few kinds: numbers that Arrow packs, instants, dates, texts; nested values as JSON."""
    out = []
    for c, kind in sorted(df.dtypes):
        x = F.col(f"`{c}`")
        if kind.startswith(("array", "map", "struct", "variant")):
            x = F.to_json(x)
        elif kind.startswith(("decimal", "float")):
            x = x.cast("double")
        elif kind in ("tinyint", "smallint", "int"):
            x = x.cast("long")
        elif kind in ("binary",):
            x = F.base64(x)
        out.append(x.alias(c))
    return df.select(*out)


def packed(name: str, column: pa.ChunkedArray) -> bytes:
    """A column as bytes, with its name and kind: little-endian 64-bit floats with one pattern for NaN and null and one for zero (whole numbers below 2^53 are the same as integers and as floats), microseconds, days, or lengths and UTF-8."""
    kind, raw = column.type, b""
    if pa.types.is_integer(kind):
        low, high = pc.min_max(column).as_py().values() if len(column) else (0, 0)
        if max(abs(low or 0), abs(high or 0)) < 1 << 53:
            column, kind = column.cast(pa.float64()), pa.float64()
    if pa.types.is_floating(kind):
        values = column.to_numpy().astype("<f8") + 0.0
        values[np.isnan(values)] = np.nan
        tag, raw = "f", values.tobytes()
    elif pa.types.is_integer(kind):
        tag, raw = "i", pc.fill_null(column, -(1 << 63)).to_numpy().astype("<i8").tobytes() + pc.is_null(column).to_numpy().tobytes()
    elif pa.types.is_boolean(kind):
        tag, raw = "b", pc.fill_null(column.cast(pa.int8()), 2).to_numpy().tobytes()
    elif pa.types.is_timestamp(kind):
        tag = "t" if kind.tz else "n"
        raw = pc.fill_null(column.cast(pa.timestamp("us", kind.tz)).cast(pa.int64()), -(1 << 63)).to_numpy().astype("<i8").tobytes()
    elif pa.types.is_date(kind):
        tag, raw = "d", pc.fill_null(column.cast(pa.int32()), -(1 << 31)).to_numpy().astype("<i4").tobytes()
    else:
        text = column.cast(pa.string())
        tag, raw = "s", pc.fill_null(pc.binary_length(text), -1).to_numpy().astype("<i8").tobytes() + "".join(x or "" for x in text.to_pylist()).encode()
    return json.dumps([name, tag, len(column)]).encode() + b"\0" + raw


def _leaf(order: Sequence[str], columns: Sequence[str]):  # noqa: ANN202
    """SHA-256 of a group's rows, sorted by order and, where that ties, by all columns."""

    def run(table: pa.Table) -> bytes:
        for k, c in enumerate(table.column_names):
            if pa.types.is_floating(table.schema.field(k).type):  # a NaN sorts like a null
                x = table.column(k)
                table = table.set_column(k, c, pc.if_else(pc.is_nan(x), None, x))
        table = table.sort_by([(c, "ascending") for c in dict.fromkeys([*order, *columns])])
        digest = hashlib.sha256()
        for c in columns:
            digest.update(packed(c, table.column(c)))
        return digest.digest()

    return run


def leaf_hashes(df: DataFrame, groups: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(groups, n, digest): of each group, which must fit a task (a day, or a bucket of LEAF_ROWS rows)."""
    leaf = _leaf(order, columns)
    schema = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in groups) + ", n long, digest binary"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        made = [pa.array([k.as_py()], k.type) for k in key]
        return pa.Table.from_arrays([*made, pa.array([table.num_rows], pa.int64()), pa.array([leaf(table)], pa.binary())], names=[*groups, "n", "digest"])

    return df.groupBy(*groups).applyInArrow(run, schema)


def combined(leaves: DataFrame, groups: Sequence[str], place: Column) -> DataFrame:
    """(groups, n, digest): the digests of a group's leaves in order of place, hashed. A group has FAN leaves or so."""
    line = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.concat(place.cast("string"), F.lit(":"), F.hex("digest")).alias("h")))), lambda r: r["h"])
    return leaves.groupBy(*groups).agg(F.sum("n").alias("n"), F.unhex(F.sha2(F.array_join(line, "\n"), 256)).alias("digest"))


#: About as many rows make a leaf, and so many leaves one node above them.
LEAF_ROWS, FAN = 50_000, 1024


def content_hash(df: DataFrame, key: Sequence[str]) -> str:
    """SHA-256 of a table's content, the same for any order of rows and columns and any partitioning.

    Rows are dealt to leaves by a hash of their key, sorted and packed there column by column, and a tree of digests ends in at most FAN of them, which the driver hashes. The number of leaves follows
    the number of rows, so it is part of the content.
    """
    plain = _plain(df)
    kinds, n, leaves = dict(plain.dtypes), df.count(), 1
    while leaves * LEAF_ROWS < n:
        leaves *= 2
    number = [F.col(f"`{k}`").cast("double") + 0.0 if kinds[k] in ("bigint", "double") else F.col(f"`{k}`") for k in key]
    rows = plain.withColumn("__leaf", F.pmod(F.xxhash64(*number), F.lit(leaves)))
    level = leaf_hashes(rows, ["__leaf"], key, sorted(df.columns))
    while leaves > FAN:
        level = combined(level.withColumn("__up", F.floor(F.col("__leaf") / FAN)), ["__up"], F.col("__leaf")).withColumnRenamed("__up", "__leaf")
        leaves = -(-leaves // FAN)
    digest = hashlib.sha256(json.dumps(sorted(df.columns)).encode())
    for r in sorted(level.collect(), key=lambda r: r["__leaf"]):
        digest.update(f"{r['__leaf']}:{r['n']}:".encode() + bytes(r["digest"]))
    return digest.hexdigest()


def spec_hash(spec: dict) -> str:
    return hashlib.sha256(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()


def bar_hash(rows: DataFrame, by: Sequence[str], us: str = "bar_us", columns: Sequence[str] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """by, content_sha256, rows: of the bars in time order, packed column by column. Days are hashed first, then the days of a year, then years."""
    day = F.floor(F.col(us) / 86_400_000_000)
    days = leaf_hashes(rows.select(*by, us, *[F.col(c).cast("double").alias(c) for c in columns], day.alias("__day")), [*by, "__day"], [us], [us, *columns])
    years = combined(days.withColumn("__year", F.floor(F.col("__day") / 366)), [*by, "__year"], F.col("__day"))
    return combined(years, by, F.col("__year")).select(*by, F.lower(F.hex("digest")).alias("content_sha256"), F.col("n").alias("rows"))
