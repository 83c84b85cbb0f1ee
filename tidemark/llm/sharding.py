"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get gapless global numbers: a hash of the row's key picks one of many buckets, a row's number is the
count of all earlier buckets plus its place within its bucket. Equal rows are counted before that and spelt out after it, so that they
make no bucket large. Only the bucket counts, at most MOST_BUCKETS rows, are broadcast. The permutation works on pairs (left, right) from a * b >= n numbers, a being about the
square root of n; a number that leaves 0..n-1 is permuted again until it returns. So the place of row number r
follows from (n, seed, r) alone: shard = place mod shards, slot = place div shards.

The law is `rows`: shard sizes in rows differ by one at most. Equal rows are interchangeable. Null
texts count as empty; null ids are an id of their own. Empty tables give empty results. Other columns of the
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

#: Rows of a bucket; there are LEAST_BUCKETS at least and, broadcast as one row each, MOST_BUCKETS at most.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 200_000, 4096, 1_000_000
ROUNDS = 4
#: A walk only visits distinct numbers outside 0..n-1, fewer than a of them; for a > WALKS the
#: chance of a longer walk is below (1 / WALKS) ** WALKS, and such a row raises an error.
WALKS = 40


def div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def feistel(x: Column, a: Column, b: Column, seed: int) -> Column:
    """A permutation of 0..a*b-1. The halves go through the rounds as a struct, so each round is evaluated once."""

    def half_round(s: Column, k: Column) -> Column:
        left = F.when(k % 2 == 0, F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(seed), k, s["r"]), a), a)).otherwise(s["l"])
        right = F.when(k % 2 == 1, F.pmod(s["r"] + F.pmod(F.xxhash64(F.lit(seed), k, s["l"]), b), b)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    halves = F.struct(div(x, b).alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(F.array(*map(F.lit, range(2 * ROUNDS))), halves, half_round, lambda s: s["l"] * b + s["r"])


def permuted(row: Column, n: Column, seed: int) -> Column:
    """Where row number `row` of n goes; a permutation of 0..n-1."""
    a = F.greatest(F.ceil(F.sqrt(n)).cast("long"), F.lit(1).cast("long"))
    b = F.greatest(div(n + a - 1, a), F.lit(1).cast("long"))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)),
        feistel(row, a, b, seed),
        lambda at, _: F.when(at < n, at).otherwise(feistel(at, a, b, seed)),
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The columns in order, with __row (0..n-1, gapless) and __n (their count); __row follows (bucket, *order) and no task sees more than a bucket of distinct rows."""
    n_buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, rows.count() // BUCKET_ROWS))
    distinct = rows.groupBy(*order).agg(F.count("*").alias("__times")).withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(n_buckets)).cast("int"))
    counts = distinct.groupBy("__bucket").agg(F.sum("__times").alias("__c"))
    upto = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("__bucket", (F.sum("__c").over(upto) - F.col("__c")).alias("__before"), F.sum("__c").over(everything).alias("__n"))
    within = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = distinct.withColumn("__upto", F.sum("__times").over(within)).join(F.broadcast(offsets), "__bucket")
    first = F.col("__before") + F.col("__upto") - F.col("__times")
    # runs of equal rows, a million at a time
    run, last = F.lit(1_000_000).cast("long"), F.col("__times") - 1
    runs = placed.select(*order, "__n", "__times", first.alias("__first"), F.explode(F.sequence(F.lit(0).cast("long"), last, run)).alias("__from"))
    spelt = F.sequence(F.col("__from"), F.least(F.col("__from") + run - 1, last))
    return runs.withColumn("__k", F.explode(spelt)).select(*order, "__n", (F.col("__first") + F.col("__k")).alias("__row"))


def shard_rows(docs: DataFrame, n_shards: int = 8, seed: int = 20_240, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard (always null under this law)."""
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("__id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    place = numbered(rows, "__id", "text_crc32", "size").withColumn("__at", permuted(F.col("__row"), F.col("__n"), seed))
    shards = F.lit(n_shards).cast("long")
    return place.select(
        F.col("__id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col("__at"), shards).cast("int").alias("shard"),
        div(F.col("__at"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
