"""Immutable snapshots of official series, with pointers to the last verified one.

A snapshot is a folder that is written once, named by its time, and never changed. After it is written its content is hashed, and only
then the pointer file names it, with the hash. Readers follow the pointer and refuse what no longer has that hash.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..functions.hashing import content_hash

POINTER = "latest_verified.json"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def file_checksum(uri: str, block: int = 1 << 20) -> str:
    """SHA-256 of a file's bytes, block by block."""
    store, path = _open(uri)
    digest = hashlib.sha256()
    with store.open_input_stream(path) as f:
        while data := f.read(block):
            digest.update(data)
    return digest.hexdigest()


def save_snapshot(df: DataFrame, root: str, key: list[str], taken: dt.datetime, least_rows: int = 1) -> str | None:
    """Writes a snapshot, reads it back and, if it has the rows and the hash that df has, moves the pointer. Returns the snapshot's name, or None if it was not trusted."""
    spark, name = df.sparkSession, f"{taken:%Y%m%dT%H%M%S%f}"
    before = content_hash(df, key)
    df.write.mode("error").parquet(f"{root}/{name}")
    back = spark.read.parquet(f"{root}/{name}")
    if content_hash(back, key) != before or back.count() < least_rows:
        return None
    store, path = _open(root)
    with store.open_output_stream(f"{path}/{POINTER}") as f:
        f.write(json.dumps({"snapshot": name, "content_sha256": before, "key": key}, sort_keys=True).encode())
    return name


def latest_verified(spark: SparkSession, root: str) -> DataFrame | None:
    """The snapshot that the pointer names, if it is there and has the pointer's hash; else None."""
    store, path = _open(root)
    if store.get_file_info(f"{path}/{POINTER}").type != fs.FileType.File:
        return None
    told = json.loads(store.open_input_stream(f"{path}/{POINTER}").read())
    if store.get_file_info(f"{path}/{told['snapshot']}").type != fs.FileType.Directory or not told.get("content_sha256"):
        return None
    df = spark.read.parquet(f"{root}/{told['snapshot']}")
    return df if content_hash(df, told["key"]) == told["content_sha256"] else None


def offset_pages(fetch: Callable[[int], tuple[list, int]], limit: int) -> list:
    """All rows behind an offset protocol. fetch(offset) gives rows and the declared count; an empty page before that count, a changed count or too many rows is an error."""
    rows: list = []
    declared = None
    while declared is None or len(rows) < declared:
        page, count = fetch(len(rows))
        if declared not in (None, count):
            raise RuntimeError(f"the declared count changed from {declared} to {count}")
        declared = count
        if not page and len(rows) < declared:
            raise RuntimeError(f"an empty page after {len(rows)} of {declared} rows")
        if len(page) > limit or len(rows) + len(page) > declared:
            raise RuntimeError("more rows than declared")
        rows += page
    return rows
