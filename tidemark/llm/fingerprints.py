"""Document fingerprints: SimHash over word pairs, and search within a Hamming radius.

Each pair of neighbouring words (a single word: that word) is hashed to 64 bits, BITS / 64 times. Every place of a pair votes on each
signed bit, so a pair weighs as often as it stands. Votes are counted four to a long: a long masked with
0x0001000100010001 holds four 16-bit counters, so 16 sums give 64 bits. A text's pairs are
summed in runs of CHUNK words, below the counters' limit, and the runs are added up afterwards.

Search: fingerprints are cut into blocks, each with a number of flipped bits allowed in it; the numbers, each plus one, sum to radius + 1. So two
fingerprints within the radius differ in some block by no more than it allows, and joining the blocks of the rows with
all allowed changes of the queries' blocks misses none. `block_plan` cuts the blocks, the same way at every size. Equal fingerprints are one row there, a pair is taken in
its first table only, and blocks that many rows share are dealt out in chunks. RADIUS is what copies with a five-word shingle similarity of 0.8 need
(README: recall).

Null and empty texts have no votes; their fingerprint is all zeros. The next document is found
without a global sort task: ids are cut at quantiles into ranges of about equally many rows, which are sorted on their own, and the first row of each
range follows the last of the range before. Rows with equal ids are ordered by a hash of their texts, then the texts. A single row is its own next document.
Null ids come last. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, spread_join, text_or_empty

BITS = 128
CHUNK = 30_000
RADIUS = 24
#: Flipped bits that a table allows at most: more make fewer tables and fewer candidates, and more changes of a query's blocks.
FLIPS = 3
#: A block stands in chunks if more than a LIGHT-th of the rows, and more than LIGHT rows, have it.
LIGHT = 2000
#: Ranges of ids for each shuffle partition, and the most of them; beyond that ranges grow and their windows spill.
RANGES_A_TASK, MAX_RANGES = 2, 8192
SPACE = r"[\x20\x09-\x0D]+"
_FOUR = 0x0001000100010001


def pair_hashes(text: Column) -> Column:
    """(chunk, one hash of 64 bits for each 64 bits of the fingerprint) for each pair."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")

    def of(words: Column) -> Column:
        last = F.greatest(F.size(words) - 2, F.lit(0))
        pair = lambda i, seed: F.xxhash64(F.lit(seed), F.get(words, i), F.get(words, i + 1))
        hashed = lambda i: F.struct(F.floor(i / CHUNK).cast("int").alias("chunk"), *[pair(i, k).alias(f"h{k}") for k in range(BITS // 64)])
        return F.transform(F.sequence(F.lit(0), last), hashed)

    return F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, of(w))), 1)


def votes() -> list[Column]:
    """Sums that hold four counters each; their names are s<word>_<bit>."""
    return [F.sum(F.shiftrightunsigned(f"h{k}", b).bitwiseAND(F.lit(_FOUR))).alias(f"s{k}_{b}") for k in range(BITS // 64) for b in range(16)]


def counters() -> list[Column]:
    """The four counters of each sum, added up over the runs of a text."""
    return [F.sum(F.shiftrightunsigned(f"s{k}_{b}", 16 * j).bitwiseAND(F.lit(0xFFFF))).alias(f"c{k}_{b + 16 * j}") for k in range(BITS // 64) for b in range(16) for j in range(4)]


def fingerprint_words(n: str = "__n") -> list[Column]:
    """Bit b is set if more than half of the votes set it."""
    out = []
    for k in range(BITS // 64):
        word = F.lit(0).cast("long")
        for b in range(64):
            word = word.bitwiseOR(F.when(F.col(f"c{k}_{b}") * 2 > F.col(n), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
        out.append(word.alias(f"f{k}"))
    return out


def fingerprints(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys, and __fp: array<long>, for each row that has votes. keys must tell rows apart; rows alike in them and in text count as one."""
    hashed = rows.select(*keys, F.explode(pair_hashes(text)).alias("__v")).select(*keys, "__v.*")
    runs = hashed.groupBy(*keys, "chunk").agg(F.count("*").alias("__n"), *votes())
    sums = runs.groupBy(*keys).agg(F.sum("__n").alias("__n"), *counters())
    return sums.select(*keys, F.array(*fingerprint_words()).alias("__fp"))


def no_votes() -> Column:
    return F.array(*[F.lit(0).cast("long")] * (BITS // 64))


def as_hex(fp: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(fp[k]), 16, "0") for k in range(BITS // 64)]))


def distance(a: Column, b: Column) -> Column:
    return sum((F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(1, BITS // 64)), F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def block_plan(radius: int, flips: int = FLIPS) -> list[tuple[int, int, int]]:
    """(first bit, bits, flipped bits allowed) of each table. Any split of radius + 1 over the tables is exact; this one allows `flips` bits a table at most."""
    n = max(-(-BITS // 64), -(-(radius + 1) // (flips + 1)))
    cuts = [BITS * t // n for t in range(n + 1)]
    plan = [(cuts[t], cuts[t + 1] - cuts[t], (radius + 1) // n - 1 + (t < (radius + 1) % n)) for t in range(n)]
    return [table for table in plan if table[2] >= 0]


def changes_of(bits: int, allowed: int) -> list[int]:
    """All words of so many bits with no more than the allowed ones set, as signed longs."""
    words = (sum(1 << b for b in chosen) for k in range(allowed + 1) for chosen in itertools.combinations(range(bits), k))
    return [w - (1 << 64) if w >> 63 else w for w in words]


def block(fp: Column, first: int, bits: int) -> Column:
    """These bits of the fingerprint as a long."""
    word, at = divmod(first, 64)
    out = F.shiftrightunsigned(F.get(fp, word), at)
    if at + bits > 64:
        out = out.bitwiseOR(F.shiftleft(F.get(fp, word + 1), 64 - at))
    return out if bits == 64 else out.bitwiseAND(F.lit((1 << bits) - 1))


def within_radius(queries: DataFrame, fps: DataFrame, radius: int, flips: int = FLIPS) -> DataFrame:
    """Distinct (q, fp, distance) for all fingerprints within the radius of a query; both inputs have a column __fp. fps is read twice."""
    plan = block_plan(radius, flips)
    blocks = F.array(*[block(F.col("__fp"), first, bits) for first, bits, _ in plan])
    # one text for each table, which Spark folds into a literal: thousands of literals would burden the planner
    changes = F.array(*[F.split(F.lit(",".join(map(str, changes_of(bits, allowed)))), ",").cast("array<bigint>") for _, bits, allowed in plan])
    left = queries.select("__fp").distinct().select(F.col("__fp").alias("__q"), blocks.alias("__b"), F.posexplode(changes).alias("__table", "__c"))
    left = left.select("__q", "__table", F.get("__b", F.col("__table")).alias("__b"), F.explode("__c").alias("__c"))
    left = left.select("__q", "__table", F.col("__b").bitwiseXOR(F.col("__c")).alias("__block"))
    right = fps.select("__fp").distinct().select("__fp", F.posexplode(blocks).alias("__table", "__block"))
    light = max(LIGHT, fps.count() // LIGHT)
    heavy = right.groupBy("__table", "__block").agg(F.count("*").alias("__n")).where(F.col("__n") > light)
    # a table has fewer than LIGHT of them
    heavy = F.broadcast(heavy.select("__table", "__block", F.ceil(F.col("__n") / light).cast("int").alias("__chunks")))
    chunks = F.coalesce("__chunks", F.lit(1))
    left = left.join(heavy, ["__table", "__block"], "left").select("__q", "__table", "__block", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("__chunk"))
    right = right.join(heavy, ["__table", "__block"], "left").select("__fp", "__table", "__block", F.pmod(F.xxhash64("__fp"), chunks).cast("int").alias("__chunk"))
    q, fp = F.col("__q"), F.col("__fp")
    fits = [F.bit_count(block(q, first, bits).bitwiseXOR(block(fp, first, bits))) <= allowed for first, bits, allowed in plan]
    first = F.coalesce(*[F.when(fit, t) for t, fit in enumerate(fits)])
    near = left.join(right.hint("merge"), ["__table", "__block", "__chunk"]).where((distance(q, fp) <= radius) & (first == F.col("__table")))
    return near.select("__q", "__fp", distance(q, fp).alias("distance"))


def _at_most(cuts: list[float], x: Column) -> Column:
    """How many of the ascending cuts are at most x, by binary search in a literal array."""
    if not cuts:
        return F.lit(0)
    values = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        open_, below = s["low"] < s["high"], F.get(values, middle) <= x
        return F.struct(F.when(open_ & below, middle + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~below, middle).otherwise(s["high"]).alias("high"))

    whole = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), whole, halve, lambda s: s["low"])


def _ranges(rows: DataFrame) -> Column:
    """A number for each row (__id, __tie), ascending along descending ids, then __tie, null ids last. The ranges hold about equal numbers of
    rows: ids are cut at their quantiles, and an id (or null) with more rows than a range is cut further, evenly by __tie."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(2, min(MAX_RANGES, partitions * RANGES_A_TASK))
    x = F.col("__id").cast("double")
    found = rows.agg(F.percentile_approx(x, [k / n for k in range(1, n)], 4 * n).alias("cuts"), F.count("*").alias("n"), F.count("__id").alias("n_ids")).first()
    times = Counter(found["cuts"] or [])
    cuts = sorted(times)
    at = _at_most(cuts, x)
    # ids above 2 ** 53 may share a double with others and are not cut further
    pieces = {k: times[c] for k, c in enumerate(cuts) if times[c] > 1 and abs(c) < 2**53}
    here = (F.get(F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>"), at - 1) == x) if cuts else F.lit(False)
    heavy = F.lit(1)
    for k, m in pieces.items():  # at most n of them, one for each id that holds several ranges' rows
        heavy = F.when(here & (at == k + 1), m).otherwise(heavy)
    nulls = -(-(found["n"] - found["n_ids"]) * n // max(1, found["n"]))
    share = lambda m: F.least(F.floor((F.col("__tie").cast("double") / F.lit(2.0**64) + 0.5) * m), m - 1)
    own = -(at * 2 + F.when(here, 0).otherwise(1)).cast("long") * F.lit(1 << 20) + share(heavy)
    return F.when(F.col("__id").isNull(), F.lit(1 << 40) + share(F.lit(max(1, nulls)))).otherwise(own).cast("long")


def _with_next(rows: DataFrame) -> DataFrame:
    """rows (__id, __text) with __range, __place and __next: the text that follows in descending order of ids, null for the last of a range."""
    rows = rows.withColumn("__tie", F.xxhash64("__text"))
    order = Window.partitionBy("__range").orderBy(F.col("__id").desc_nulls_last(), "__tie", "__text")
    rows = rows.withColumn("__range", _ranges(rows)).withColumn("__place", F.row_number().over(order)).withColumn("__next", F.lead("__text").over(order))
    return rows.drop("__tie")


def _after(rows: DataFrame, column: str) -> DataFrame:
    """(__range, __after): the column of the first row of the next range, after the last range of the first. The single-task window sees the numbers of the ranges alone."""
    by_range = Window.orderBy("__range")
    firsts = rows.where("__place = 1")
    numbers = firsts.select("__range").withColumn("__to", F.coalesce(F.lead("__range").over(by_range), F.first("__range").over(by_range)))
    return numbers.join(firsts.select(F.col("__range").alias("__to"), F.col(column).alias("__after")), "__to").drop("__to")


def fingerprint_report(docs: DataFrame, radius: int = RADIUS, query_mod: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id, n_near, near_ids.

    class_id: the smallest id with this fingerprint (null if all of them are). For ids that query_mod divides, n_near: how many rows, itself
    included, have fingerprints within the radius, and near_ids: the classes of these, ascending; else null. Copies are not spelt out: a
    class's members have its class_id.
    """
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    rows = _with_next(rows)
    whole = rows.join(_after(rows, "__text"), "__range").withColumn("__next", F.coalesce("__next", "__after"))
    n = F.length("__text").cast("long")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("__text"), F.lit(1), (n - cut).cast("int")), F.substring(F.col("__next"), F.lit(1), cut))
    whole = whole.select("__range", "__place", "__id", n.alias("n_chars"), "__text", edited.alias("__edited"))
    keys = ["__range", "__place", "__id"]
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("__kind"), F.col("__text").alias("__t")), F.struct(F.lit(1).alias("__kind"), F.col("__edited").alias("__t"))))
    both = whole.select(*keys, kinds.alias("__k")).select(*keys, "__k.*")
    fps = fingerprints(both, [*keys, "__kind"], F.col("__t"))
    fps = fps.groupBy(*keys).agg(F.max(F.when(F.col("__kind") == 0, F.col("__fp"))).alias("__fp"), F.max(F.when(F.col("__kind") == 1, F.col("__fp"))).alias("__efp"))
    facts = whole.select("__range", "__place", "__id", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"))
    one = facts.join(fps.drop("__id"), ["__range", "__place"], "left")
    one = one.withColumn("__fp", F.coalesce("__fp", no_votes())).withColumn("__efp", F.coalesce("__efp", no_votes()))
    one = settled(one, "fingerprints")
    following = Window.partitionBy("__range").orderBy("__place")
    out = one.withColumn("__next", F.lead("__fp").over(following)).join(_after(one, "__fp"), "__range").withColumn("__next", F.coalesce("__next", "__after")).drop("__after")
    asked = F.coalesce(F.col("__id").cast("long") % query_mod == 0, F.lit(False))
    classes = settled(one.groupBy("__fp").agg(F.min("__id").alias("class_id"), F.count("*").alias("__rows"), F.bool_or(asked).alias("__asked")), "classes")
    pairs = within_radius(classes.where("__asked"), classes, radius)
    near = pairs.join(classes.select("__fp", "class_id", "__rows"), "__fp").groupBy("__q").agg(F.sum("__rows").alias("n_near"), F.sort_array(F.collect_list("class_id")).alias("near_ids"))
    classes = settled(classes.join(near.withColumnRenamed("__q", "__fp"), "__fp", "left"), "near")
    out = spread_join(out, classes, ["__fp"], "__rows", one.count(), ["__range", "__place"])
    return out.select(
        F.col("__id").alias(id_col), "n_chars", "edited_sha256", as_hex(F.col("__fp")).alias("fingerprint"), as_hex(F.col("__efp")).alias("edited_fingerprint"),
        likeness(F.col("__fp"), F.col("__efp")).alias("near_edited"), likeness(F.col("__fp"), F.col("__next")).alias("near_next"), "class_id",
        F.when(asked, F.col("n_near")).alias("n_near"), F.when(asked, F.col("near_ids")).alias("near_ids"),
    )
