"""Comparison of two vendors' bars: one full outer join on (symbol, start), then conditional aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import float_ratio, ln, pearson, ratio
from ..functions.times import ny_date
from .scans import quantile_columns

FIELDS = ("open", "high", "low", "close")


class Incompatible(ValueError):
    pass


@dataclass(frozen=True)
class Side:
    label: str
    source: str
    feed: str
    feed_scope: str
    adjustment: str
    timeframe: str


def check_compatible(a: Side, b: Side) -> bool:
    """Raises if a comparison would say nothing; returns whether volumes are of the same scope."""
    for what in ("timeframe", "adjustment"):
        if getattr(a, what) != getattr(b, what):
            raise Incompatible(f"{what} differs: {a.label}={getattr(a, what)}, {b.label}={getattr(b, what)}")
    if (a.source, a.feed) == (b.source, b.feed):
        raise Incompatible(f"both sides are {a.source}/{a.feed}")
    return a.feed_scope == b.feed_scope


def matched(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("symbol", "bar_us"), fields: tuple[str, ...] = (*FIELDS, "volume")) -> DataFrame:
    """keys, a_<field>, b_<field>, in_a, in_b: the only shuffle join of the comparison."""
    left = a.select(*keys, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("in_b"))
    both = left.join(right, list(keys), "full_outer")
    return both.withColumns({"in_a": F.coalesce("in_a", F.lit(False)), "in_b": F.coalesce("in_b", F.lit(False))})


def with_regular(rows: DataFrame, sessions: DataFrame, us: str = "bar_us") -> DataFrame:
    """regular: the bar starts inside its New York date's session."""
    s = sessions.select(F.col("ny_date").alias("s_d"), F.unix_micros("open").alias("s_o"), F.unix_micros("close").alias("s_c"))
    out = rows.join(s, ny_date(F.timestamp_micros(us)) == F.col("s_d"), "left")
    return out.withColumn("regular", F.coalesce((F.col(us) >= F.col("s_o")) & (F.col(us) < F.col("s_c")), F.lit(False))).drop("s_d", "s_o", "s_c")


def coverage(pairs: DataFrame, by: str = "symbol") -> DataFrame:
    both, a, b = F.col("in_a") & F.col("in_b"), F.col("in_a"), F.col("in_b")
    n = lambda c: F.count_if(c)
    return pairs.groupBy(by).agg(
        n(a).alias("n_a"), n(b).alias("n_b"), n(both).alias("n_both"), n(a & ~b).alias("n_only_a"), n(b & ~a).alias("n_only_b"),
        ratio(n(both), F.count("*")).alias("overlap_over_union"), ratio(n(both), n(a)).alias("overlap_over_a"), ratio(n(both), n(b)).alias("overlap_over_b"),
    )


#: Exact quantiles of the reports.
SHARES = {"median": 0.5, "p95": 0.95}


def _described(rows: DataFrame, by: list[str], measures: dict[str, Column], *more: Column) -> DataFrame:
    """(by, then n, median, p95 and max of each measure, then more). Quantiles come from one scan of all measures' values, spread over tasks by value."""
    ends = rows.groupBy(*by).agg(*[f(c).alias(f"{m}_{n}") for m, c in measures.items() for n, f in (("n", F.count), ("max", F.max))], *more)
    inner = quantile_columns(rows, by, measures, SHARES)
    out = ends.join(inner, by, "left")
    return out.select(*by, *[f"{m}_{n}" for m in measures for n in ("n", "median", "p95", "max")], *[c for c in ends.columns[len(by) + 2 * len(measures) :]])


def price_stats(pairs: DataFrame, by: str = "symbol", scope: str | None = None) -> DataFrame:
    """For each field and scope (all, or regular and extended too): n, median, p95 and max of absolute and relative differences, and the share of equal prices.

    The relative difference is by the mean of both sizes.
    """
    both = pairs.where("in_a and in_b")
    long = both.select(by, *([scope] if scope else []), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("x"), F.col(f"b_{f}").alias("y")) for f in FIELDS])).alias("v"))
    long = long.select(by, *([scope] if scope else []), "v.*")
    scopes = F.array(F.lit("all"), F.when(F.col(scope), "regular_session").otherwise("extended_hours")) if scope else F.array(F.lit("all"))
    long = long.withColumn("scope", F.explode(scopes))
    gap = F.abs(F.col("x") - F.col("y"))
    long = long.withColumn("abs_diff", gap).withColumn("rel_diff", ratio(gap, (F.abs("x") + F.abs("y")) / 2))
    return _described(long, [by, "field", "scope"], {c: F.col(c) for c in ("abs_diff", "rel_diff")}, ratio(F.count_if(F.col("abs_diff") == 0), F.count("*")).alias("exact_equal_fraction"))


def volume_stats(pairs: DataFrame, by: str = "symbol") -> DataFrame:
    both = pairs.where("in_a and in_b")
    a, b = F.col("a_volume"), F.col("b_volume")
    some = F.when(b > 0, ratio(a, b))
    return _described(both, [by], {"abs_diff": F.abs(a - b), "pct_diff": F.abs(some - 1), "ratio": some}, F.sum(a).alias("total_a"), F.sum(b).alias("total_b"))


def return_pairs(pairs: DataFrame, step_us: int, by: str = "symbol", us: str = "bar_us", day: Column | None = None) -> DataFrame:
    """Log returns of both sides between bars that both have exactly one step apart, on the same day; -inf to a price of 0, inf from it."""
    both = pairs.where("in_a and in_b").withColumn("__day", ny_date(F.timestamp_micros(us)) if day is None else day)
    w = Window.partitionBy(by, "__day").orderBy(us)
    follows = F.lag(us).over(w) == F.col(us) - step_us
    r = lambda c: F.when(follows, ln(float_ratio(F.col(c), F.lag(c).over(w))))
    out = both.withColumns({"r_a": r("a_close"), "r_b": r("b_close"), "__follows": follows})
    if "regular" in both.columns:
        out = out.withColumn("regular_return", F.col("regular") & F.lag("regular").over(w))
    return out.where("__follows").drop("__follows", "__day")


def return_correlation(returns: DataFrame, by: str = "symbol", flat: float | None = None) -> DataFrame:
    """n and Pearson correlation; null below three pairs, `flat` without variation, NaN if a return is not finite."""
    return returns.groupBy(by).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, pearson("r_a", "r_b", flat)).alias("corr"))


def largest_differences(pairs: DataFrame, k: int = 10, us: str = "bar_us") -> DataFrame:
    both = pairs.where("in_a and in_b").withColumn("abs_diff", F.abs(F.col("a_close") - F.col("b_close")))
    return both.orderBy(F.desc("abs_diff"), us, "symbol").limit(k).select("symbol", us, "a_close", "b_close", "abs_diff")


def session_presence(pairs: DataFrame, sessions: DataFrame) -> DataFrame:
    """For each session which side has regular bars: both, a, b or none."""
    seen = pairs.where("regular").groupBy(ny_date(F.timestamp_micros("bar_us")).alias("ny_date")).agg(F.bool_or("in_a").alias("a"), F.bool_or("in_b").alias("b"))
    out = sessions.select("ny_date").join(seen, "ny_date", "left")
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    return out.select("ny_date", F.when(a & b, "both").when(a, "a").when(b, "b").otherwise("none").alias("presence"))
