"""Exact dedup by deterministic block naming.

A document's text without white space is cut into blocks of BLOCK bytes. All distinct blocks are sorted, byte by byte,
and named by their places in that order. Then adjacent names are paired, distinct pairs are
sorted and named in turn, and so on until each document is one name: with the number of rounds it took, its
identity. Names are places in a sorted list of distinct values, so they depend on the texts alone, and two documents have one identity
exactly when their texts are equal; no hash decides.

Distinct values are found by groupBy, which combines copies before the shuffle. They are sorted in ranges cut by whole values, so a head that
many blocks share does no harm; the driver samples SAMPLES values for each range. A range's first place is the number of values in the ranges
before it. A block's name travels to its documents by a pair of hashes; the table of names is checked for two blocks with the
same pair, and other seeds are taken if there are any. Names that many rows have are dealt out over several tasks. Rounds are written to the shared folder.

Null texts count as empty, and all empty texts are equal. Of equal texts the row with the most code
points in the original stays, then the smallest id (null ids last), then one of the equal rows. Repeated rows are rows of their own. Empty tables give empty results.
Other columns of the input are ignored by `exact_dedup` and kept by `deduplicated`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Scratch, pick, plain_names, settled, spread_join, text_or_empty

SPACES = " \t\n\x0b\x0c\r"
BLOCK = 2048
#: Values that the driver samples for each range of a sort (Spark takes three times as many): 60 KB of blocks a range.
SAMPLES = 10
_SAMPLES = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
NONE = -1


def normalised(text: str | Column) -> Column:
    return F.translate(text_or_empty(text), SPACES, "")


def _blocks(text: Column) -> Column:
    """Blocks of BLOCK bytes; one empty block for an empty text."""
    data = F.encode(text, "utf-8")
    last = F.greatest(F.lit(0), F.floor((F.octet_length(data) - 1) / F.lit(BLOCK)).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * BLOCK + 1, F.lit(BLOCK)))


@contextmanager
def _few_samples(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_SAMPLES)
    spark.conf.set(_SAMPLES, str(SAMPLES))
    try:
        yield
    finally:
        spark.conf.set(_SAMPLES, before)


def _in_order(distinct: DataFrame, order: list[str], carry: list[Column], name: str) -> DataFrame:
    """The columns in carry, __part and __at: the range of each row and its place in it."""
    with _few_samples(distinct.sparkSession):
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        return settled(distinct.repartitionByRange(*order).sortWithinPartitions(*order).select(*carry, F.spark_partition_id().alias("__part"), place.alias("__at")), name)


def _named(distinct: DataFrame, order: list[str], carry: list[Column], name: str) -> DataFrame:
    """The columns in carry, and __name: each row's place in the order, from 0 without gaps."""
    rows = _in_order(distinct, order, carry, name)
    # a row for each range
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = sizes.select("__part", (F.sum("__n").over(upto) - F.col("__n")).alias("__before"))
    return rows.join(F.broadcast(before), "__part").withColumn("__name", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def _keys(block: Column, seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(seed), block), F.xxhash64(F.lit(seed + 1), block)


def _block_names(texts: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """(__h, __g, __times, __name) of each distinct block, and the seed of the hashes."""
    distinct = texts.select(F.explode(_blocks(F.col("__norm"))).alias("__block")).groupBy("__block").agg(F.count("*").alias("__times"))
    while True:
        h, g = _keys(F.col("__block"), seed)
        names = _named(distinct, ["__block"], [h.alias("__h"), g.alias("__g"), F.col("__times")], "blocks")
        if not names.groupBy("__h", "__g").count().where("count > 1").take(1):
            return names, seed
        seed += 2


def identities(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (the columns in keep, __rid, __chars, __sha), and (__rid, __round, __name)."""
    text = text_or_empty(text_col)
    texts = docs.select(normalised(text_col).alias("__norm"))
    names, seed = _block_names(texts, 1)
    rows = docs.withColumn("__norm", normalised(text_col))
    keys = F.transform(_blocks(F.col("__norm")), lambda b: F.struct(*[k.alias(n) for k, n in zip(_keys(b, seed), ("h", "g"))]))
    rows = settled(
        rows.select(
            *keep, F.monotonically_increasing_id().alias("__rid"), F.length(text).cast("long").alias("__chars"), F.sha2(F.col("__norm"), 256).alias("__sha"), keys.alias("__keys")
        ),
        "rows",
    )
    at = rows.select("__rid", F.size("__keys").alias("__n"), F.posexplode("__keys").alias("__pos", "__key"))
    at = at.select("__rid", "__n", "__pos", F.col("__key.h").alias("__h"), F.col("__key.g").alias("__g"))
    n_places = names.agg(F.coalesce(F.sum("__times"), F.lit(0))).first()[0]
    now = settled(spread_join(at, names, ["__h", "__g"], "__times", n_places, ["__rid", "__pos"]).select("__rid", "__n", "__pos", "__name"), "round")
    done = []
    for turn in range(64):
        done.append(now.where("__n = 1").select("__rid", F.lit(turn).alias("__round"), "__name"))
        left = now.where("__n > 1")
        if not left.take(1):
            break
        even = F.col("__pos") % 2 == 0
        pairs = left.groupBy("__rid", F.floor(F.col("__pos") / 2).cast("int").alias("__at")).agg(
            F.max("__n").alias("__n"), F.max(F.when(even, F.col("__name"))).alias("__a"), F.coalesce(F.max(F.when(~even, F.col("__name"))), F.lit(NONE)).alias("__b")
        )
        pairs = settled(pairs.withColumnRenamed("__at", "__pair"), "pairs")
        distinct = pairs.groupBy("__a", "__b").agg(F.count("*").alias("__times"))
        names = _named(distinct, ["__a", "__b"], [F.col(c) for c in ("__a", "__b", "__times")], "names")
        named = spread_join(pairs, names, ["__a", "__b"], "__times", pairs.count(), ["__rid", "__pair"])
        now = settled(named.select("__rid", F.ceil(F.col("__n") / 2).cast("int").alias("__n"), F.col("__pair").alias("__pos"), "__name"), "round")
    identity = done[0]
    for x in done[1:]:
        identity = identity.unionByName(x)
    return rows, identity


def _grouped(rows: DataFrame, identity: DataFrame, id_col: str) -> DataFrame:
    """Each row with its group's best row and size."""
    whole = settled(rows.join(identity, "__rid"), "identities")
    order = F.struct((-F.col("__chars")).alias("c"), F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col("__rid").alias("rid"))
    groups = settled(whole.groupBy("__round", "__name").agg(F.min(order).alias("__best"), F.count("*").alias("__size")), "groups")
    return spread_join(whole, groups, ["__round", "__name"], "__size", whole.count(), ["__rid"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 of each row, dropped ones too."""
    rows, identity = identities(docs, text_col, (id_col,))
    kept = F.col("__rid") == F.col("__best.rid")
    return _grouped(rows.drop("__keys"), identity, id_col).select(
        id_col, F.col("__best.id").alias("keep_id"), F.col("__size").alias("group_size"), kept.alias("kept"), F.col("__sha").alias("text_sha256")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs. Only the list of the dropped ids is left in the shared folder; where ids are null or stand twice, or aren't integers, the rows are too."""
    plain, name = plain_names(docs)
    key = name[id_col]
    by_id = isinstance(plain.schema[key].dataType, IntegralType) and not plain.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).take(1)
    with Scratch(docs.sparkSession) as own:
        rows, identity = identities(plain, name[text_col], (key,) if by_id else tuple(plain.columns))
        grouped = _grouped(rows.select("__rid", "__chars", key), identity, key)
        if by_id:
            rows, at, stay = plain, key, ("dropped",)
        else:
            at, stay = "__rid", ("rows", "dropped")
        dropped = settled(grouped.where("__rid <> __best.rid").select(at), "dropped")
        own.discard(stay)
    return pick(rows, dropped, at, "left_anti").select(*plain.columns).toDF(*docs.columns)
