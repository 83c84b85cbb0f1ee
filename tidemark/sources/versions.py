"""Partitioned Parquet tables with snapshots: immutable partition versions, and a log that says which of them are live.

A write makes new folders `data/v=ID/<partition>/...`, and then one small file `_log/<number>.json` names them as the live versions of their partitions. That file appears whole or not at all,
and only if nobody has taken its number (a link or a rename that refuses an existing name). So a writer that dies leaves the old table as it was, a reader
keeps the version it began with, and of two writers of the same partition the second is told (`Conflict`), while writers of different ones go on behind each other.

Each FULL-th entry lists all live partitions, the others what they change. On file systems whose rename isn't atomic (plain object stores) the log's folder must be elsewhere.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.dedup import keep_last, upsert

FULL = 20
#: Spark's folder for a null partition value: a fixed value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Another writer has changed a partition of this write since it was read."""


@dataclass
class State:
    """What is live at a version: partition folder -> version id; and how many folders each id wrote."""

    version: int = -1
    live: dict[str, str] = field(default_factory=dict)
    wrote: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, partitions: Sequence[str]):
        self.spark, self.root, self.partitions = spark, root.rstrip("/"), list(partitions)
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    # -- files, by Hadoop's file systems

    def _path(self, *parts: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, *parts: str) -> list[str]:
        path, files = self._path(*parts)
        return [f.getPath().getName() for f in files.listStatus(path) if f.isDirectory()] if files.exists(path) else []

    def _numbers(self) -> list[int]:
        path, files = self._path("_log")
        if not files.exists(path):
            return []
        return sorted(int(n[:-5]) for f in files.listStatus(path) if (n := f.getPath().getName()).endswith(".json") and n[:-5].isdigit())

    def _entry(self, number: int) -> dict:
        path, files = self._path("_log", f"{number:020}.json")
        stream = files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, number: int, entry: dict) -> bool:
        """Whether the entry took its number."""
        jvm = self.spark._jvm
        draft, files = self._path("_log", f".{uuid.uuid4().hex}")
        final, _ = self._path("_log", f"{number:020}.json")
        out = files.create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if files.getScheme() == "file":
                os.link(draft.toUri().getPath(), final.toUri().getPath())
                return True
            kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            how = self.spark.sparkContext._gateway.new_array(kinds, 1)
            how[0] = kinds.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, how)
            return True
        except FileExistsError:
            return False
        except Exception as fault:  # noqa: BLE001  a Java exception
            if "FileAlreadyExists" in str(fault):
                return False
            raise
        finally:
            if files.exists(draft):
                files.delete(draft, False)

    # -- reading

    def state(self, version: int | None = None) -> State:
        numbers = [n for n in self._numbers() if version is None or n <= version]
        if version is not None and version not in numbers:
            raise ValueError(f"there is no version {version}")
        out, entries = State(), []
        for n in reversed(numbers):
            entries.append((n, self._entry(n)))
            if entries[-1][1]["full"]:
                break
        for n, e in reversed(entries):
            out.version = n
            if e["full"]:
                out.live, out.wrote = {}, {}
            out.live |= e["parts"]
            out.wrote |= e["wrote"]
        return out

    def _frame(self, live: dict[str, str], wrote: dict[str, int]) -> DataFrame:
        held: dict[str, list[str]] = {}
        for part, v in live.items():
            held.setdefault(v, []).append(part)
        paths = [p for v, parts in held.items() for p in ([f"{self.root}/data/v={v}"] if len(parts) == wrote.get(v) else [f"{self.root}/data/v={v}/{part}" for part in parts])]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        full = StructType(self.schema.fields).add("v", "string")
        return self.spark.read.schema(full).option("basePath", f"{self.root}/data").parquet(*paths).select(*self.schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version (the latest). Later writes don't change what is read."""
        at = self.state(version)
        return self._frame(at.live, at.wrote)

    def history(self) -> list[dict]:
        return [{"version": n, **self._entry(n)["note"]} for n in self._numbers()]

    # -- writing

    def _touched(self, batch: DataFrame) -> set[tuple[str, ...]]:
        """Partition values of a batch, as texts: a row for each partition comes to the driver."""
        return {tuple(NULL_PARTITION if x is None else x for x in r) for r in batch.select(*[F.col(p).cast("string") for p in self.partitions]).distinct().collect()}

    def _write(self, df: DataFrame) -> tuple[str, list[str]]:
        """A new version id, and the partition folders that it has."""
        v = uuid.uuid4().hex
        df.select(*self.schema.names).write.partitionBy(*self.partitions).parquet(f"{self.root}/data/v={v}")
        found = [""]
        for _ in self.partitions:
            found = [f"{at}/{f}".lstrip("/") for at in found for f in self._folders("data", f"v={v}", *([at] if at else []))]
        return v, sorted(found)

    def commit(self, base: State, v: str, parts: Sequence[str], note: dict) -> int:
        """Makes parts of v live on top of base; the new version. Raises Conflict if any of them changed since base."""
        now = base
        while True:
            number = now.version + 1
            changed = {p: v for p in parts}
            full = number % FULL == 0
            live = now.live | changed
            entry = {"full": full, "parts": live if full else changed, "wrote": {x: n for x, n in (now.wrote | {v: len(parts)}).items() if not full and x == v or full and x in set(live.values())}, "note": {"at": dt.datetime.now(dt.timezone.utc).isoformat(), **note}}
            if self._put(number, entry):
                return number
            now = self.state()
            if lost := [p for p in parts if now.live.get(p) != base.live.get(p)]:
                raise Conflict(f"{len(lost)} partitions were changed by another writer, {lost[0]} among them")

    def upsert(self, batch: DataFrame, keys: Sequence[str], note: dict | None = None, accept: Callable[[DataFrame], str | None] | None = None, retries: int = 3) -> int | None:
        """Merges a batch into its partitions, new rows winning; the version, or None if `accept`, which sees the merged partitions, gives a reason against them.

        A refused attempt keeps its folder and an entry in the log that names it, but nothing becomes live.
        """
        touched = self._touched(batch)
        for left in range(retries, -1, -1):
            base = self.state()
            old = {part: v for part, v in base.live.items() if tuple(unquote(x.partition("=")[2]) for x in part.split("/")) in touched}
            stored = self._frame(old, base.wrote) if old else None
            v, parts = self._write(upsert(stored, batch.select(*self.schema.names), keys))
            reason = accept(self._frame({p: v for p in parts}, {v: len(parts)})) if accept else None
            try:
                done = self.commit(base, v, [] if reason else parts, (note or {}) | ({"refused": reason, "attempt": v} if reason else {}))
                return None if reason else done
            except Conflict:
                if not left:
                    raise
        raise AssertionError("no attempt")

    def stream(self, source: DataFrame, checkpoint: str, keys: Sequence[str], order: Sequence[str]) -> StreamingQuery:
        """A stream into the table, to the end of what is there. A batch that was committed before a crash isn't merged twice: the log names the stream and the batch."""

        def merge(batch: DataFrame, number: int) -> None:
            if any(h.get("stream") == checkpoint and h.get("batch", -1) >= number for h in self.history()):
                return
            self.upsert(keep_last(batch, keys, *order), keys, {"stream": checkpoint, "batch": number})

        return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def vacuum(self, keep: int, older_than: dt.timedelta = dt.timedelta(days=1)) -> int:
        """Deletes version folders that none of the last `keep` versions has and that are older than that (a writer may still be at a younger one); their number."""
        numbers = self._numbers()
        held = {v for n in numbers[-keep:] for v in self.state(n).live.values()}
        path, files = self._path("data")
        before = (dt.datetime.now(dt.timezone.utc) - older_than).timestamp() * 1000
        gone = [f.getPath() for f in files.listStatus(path) if f.getPath().getName().removeprefix("v=") not in held and f.getModificationTime() <= before]
        for p in gone:
            files.delete(p, True)
        return len(gone)
