"""Mixing sources to target weights.

Documents get hash-random keys, md5 of the seed and the id. Within a source they are ordered by key: the
first hex digits of the key (more for larger tables) cut each source into ranges, range sums give each range its offset, and
running sums are only taken within a range, so no task holds a whole source. A source's target
is cut exactly, to the word; a target above the source's size repeats whole passes, three at most.

Targets: sources in code-point order, null last, weigh `weights`, repeating. They share all
words; none gets more than MAX_EPOCHS times its size, and what is above is shared by weight among the others.

Null and empty texts have size 0 and nothing is taken of them; texts are counted whole. Null sources form one source. Documents with
equal ids are ordered by size and then by two hashes of all their columns, so rows that tie are the same row and any partitioning gives the same mix; null ids have keys
from these hashes and are spread like others. Repeated rows are rows like others. Without words at all, targets are 0. Empty tables give empty results. Names made up on the way can't clash with
other columns in `mixture` and `mix_report`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import plain_names, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: About as many rows of a source make a range; ranges are cut by leading hex digits of the key, MIN_DIGITS at least.
RANGE_ROWS, MIN_DIGITS = 200_000, 3


def n_words(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """From (__source, source_size): also target. The rows are sources, not documents.

    With cap / weight ascending, the capped sources come first: level_k is the share of a weight if all before k
    are capped, and the first k whose cap is not below level_k * weight fixes the level.
    """
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    s = sources.withColumn("__w", w).withColumn("__cap", F.col("source_size") * MAX_EPOCHS)
    order = Window.orderBy((F.col("__cap") / F.col("__w")).asc(), F.col("__source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("__left", F.sum("source_size").over(total) - (F.sum("__cap").over(before) - F.col("__cap")))
    s = s.withColumn("__weigh", F.sum("__w").over(total) - (F.sum("__w").over(before) - F.col("__w")))
    s = s.withColumn("__level", F.col("__left") / F.col("__weigh")).withColumn("__k", F.row_number().over(order))
    fits = F.when(F.col("__cap") >= F.col("__level") * F.col("__w"), F.struct("__k", "__level"))
    s = s.withColumn("__level", F.min(fits).over(total)["__level"])
    return s.select("__source", "source_size", F.least(F.col("__cap").cast("double"), F.col("__level") * F.col("__w")).alias("target"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All columns of docs, with __size, __source_size, __target, __taken."""
    every = [F.to_json(c) if t.startswith(("map", "variant")) else F.col(c) for c, t in docs.dtypes]
    first, second = F.xxhash64(*every), F.xxhash64(F.lit(seed), *every)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.concat_ws(":", F.lit("null"), first, second))))
    digits = MIN_DIGITS
    n = docs.count()
    while n > RANGE_ROWS * 16**digits:
        digits += 1
    rows = docs.withColumn("__size", n_words(text_col)).withColumn("__key", key).withColumns({"__range": F.substring("__key", 1, digits), "__tie": F.struct(first, second)})
    rows = rows.withColumn("__source", F.col(source_col))
    ranges = rows.groupBy("__source", "__range").agg(F.sum("__size").alias("__sum"))
    upto = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = ranges.withColumn("__before", F.sum("__sum").over(upto) - F.col("__sum"))
    targets = source_targets(ranges.groupBy("__source").agg(F.sum("__sum").alias("source_size")), weights)
    targets = targets.select(F.col("__source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    offsets = offsets.join(targets, F.col("__source").eqNullSafe(F.col("__s"))).select(F.col("__source").alias("__s"), F.col("__range").alias("__r"), "__before", "__source_size", "__target")
    within = Window.partitionBy("__source", "__range").orderBy("__key", "__size", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__upto", F.sum("__size").over(within))
    rows = rows.join(offsets, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    start, budget, zero = F.col("__before") + F.col("__upto") - F.col("__size"), F.round("__target").cast("long"), F.lit(0).cast("long")
    taken = sum((F.greatest(zero, F.least(F.col("__size"), budget - start - F.col("__source_size") * e)) for e in range(MAX_EPOCHS)), zero)
    return rows.withColumn("__taken", taken).drop("__key", "__range", "__source", "__upto", "__s", "__r", "__before", "__tie")


def mix_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """id, size, source_size, target, taken for each row."""
    rows = _plainly_mixed(docs, id_col=id_col, **options)[0]
    return rows.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def _plainly_mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> tuple[DataFrame, list[str]]:
    """mixed under names that can't clash, and the names that stand for docs' own columns."""
    plain, name = plain_names(docs)
    rows = mixed(plain, id_col=name[id_col], text_col=name[text_col], source_col=name[source_col], **options)
    return rows.withColumn("__id", F.col(name[id_col])), plain.columns


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs as often as they are taken; a part of a pass counts if it is at least half of the document. Documents without words cost no budget and stay once."""
    times = F.when(F.col("__size") > 0, F.floor((F.col("__taken") + F.col("__size") / 2) / F.col("__size"))).otherwise(1).cast("int")
    rows, own = _plainly_mixed(docs, **options)
    rows = rows.withColumn("__times", times).where("__times > 0")
    return rows.select(*own, F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__pass")).drop("__pass").toDF(*docs.columns)
