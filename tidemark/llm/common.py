"""What the corpus operators share: the cluster's shared folder, lineage cuts, checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import shuffles_dropped

#: Most rows that `pick` sends to every executor; beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000

#: `spread_join` deals out keys that more than a LIGHT-th of the rows have, and more than LIGHT rows.
LIGHT = 1000

_own_dir: list[str] = []
#: Intermediate tables of this process, and those of the innermost Scratch of this thread.
_paths: list[str] = []
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder and any other an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        path = _own_dir[0]
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used yet."""
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}/{name}"
    _paths.append(path)
    if (own := _scratch.get()) is not None:
        own.append(path)
    return path


def _delete(spark: SparkSession, paths: Sequence[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p.rpartition("/")[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """`with Scratch(spark) as own`: what is settled within, by this thread, is its own. `own.discard(keep)` deletes those tables but for the names in keep; for use where all that comes later only reads those."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.token = _scratch.set(self.paths)
        return self

    def __exit__(self, *fault: object) -> None:
        _scratch.reset(self.token)
        if (outer := _scratch.get()) is not None:
            outer += self.paths

    def discard(self, keep: Sequence[str] = ()) -> None:
        gone = [p for p in self.paths if p.rpartition("/")[2] not in keep]
        self.paths[:] = [p for p in self.paths if p not in gone]
        _forget(gone)
        _delete(self.spark, gone)


def _forget(gone: Sequence[str]) -> None:
    _paths[:] = [p for p in _paths if p not in set(gone)]


def clean_up(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this process has written so far; their number. Results that are still to be read from them must be written or collected before."""
    gone = list(_paths)
    _forget(gone)
    _delete(spark, gone)
    return len(gone)


def drop_table(df: DataFrame) -> None:
    """Deletes the intermediate tables that df reads; for use once what was made of it is settled."""
    files = df.inputFiles()
    gone = [p for p in _paths if any(p.split("://")[-1].lstrip("/") in f for f in files)]
    _forget(gone)
    _delete(df.sparkSession, gone)


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ... and the new name of each old one: names made up on the way can't clash with them. `.toDF(*docs.columns)` gives the old names back."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def settled(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps don't recompute it, and lost executors don't lose it. Its shuffle files go at once."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, ids: DataFrame, key: str, how: str, n_rows: int | None = None) -> DataFrame:
    """df joined with ids on key. ids must be settled; it is broadcast only if its counted rows stay within BROADCAST_ROWS."""
    n = ids.count() if n_rows is None else n_rows
    return df.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, key, how)


def spread_join(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, n_rows: int, spread_by: Sequence[str]) -> DataFrame:
    """rows joined with groups on keys (never null there). groups has one row for each key, settled, and in `size` how many of the n_rows rows have it.

    Keys with many rows are dealt out over several tasks by a hash of spread_by; they are fewer than LIGHT, so their list is broadcast."""
    light = max(LIGHT, n_rows // LIGHT)
    deals = F.ceil(F.col(size) / light).cast("int")
    heavy = groups.where(F.col(size) > light).select(*keys, deals.alias("__deals"))
    own = rows.join(F.broadcast(heavy), list(keys), "left").withColumn("__deal", F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("__deals")).cast("int"), F.lit(0))).drop("__deals")
    dealt = groups.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.when(F.col(size) > light, deals - 1).otherwise(0))))
    return own.join(dealt, [*keys, "__deal"]).drop("__deal")


def text_or_empty(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))
