"""The feature layer's market response: an as-of baseline bar, post and pre returns, excursions, volatility, volumes.

Time is cut into buckets as wide as the whole span that a release may need, from the earliest possible baseline to the last post bar. Each bucket's
bars, with those of the next, are packed into one array. Releases are brought to their places on the grid (the steps at or before and at or after them), which are few however many releases there
are: a place meets all its bars by one equi-join on (symbol, bucket), its features are array expressions, and releases take them by an equi-join on the place. No row stands for an offset. The baseline is the latest bar within the lookback before the release, and pre
returns are measured from it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import coalesced_status, direction, ln, ratio
from ..functions.times import MINUTE_US, long

POST_HORIZONS, PRE_HORIZONS, EXCURSIONS = (1, 5, 15, 30, 60), (5, 30), (5, 30, 60)


@dataclass(frozen=True)
class ResponseSpec:
    pre: int = 30
    post: int = 60
    lookback: int = 5
    tolerance: float = 1e-12
    step_us: int = MINUTE_US


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], t_us: str, r_us: str, steps: int, step_us: int, values: Sequence[str]) -> DataFrame:
    """left with the latest row of right that lies 1 .. steps grid steps before t (never at t): values and r_us, null if none does."""
    ids = left.columns
    probe = left.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    probe = probe.withColumn("__at", F.col(t_us) - F.pmod(F.col(t_us), F.lit(step_us)) - F.col("__k") * long(step_us))
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col(r_us).alias("__r"), *[F.col(v).alias(f"__v_{v}") for v in values])
    on = F.col("__at") == F.col("__r")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__r_{k}"))
    # a left join keeps releases without a bar; rows of left are told apart by all their columns
    found = probe.join(r, on, "left").groupBy(*ids).agg(F.max("__r").alias("__best"), *[F.max_by(f"__v_{v}", "__r").alias(f"__b_{v}") for v in values])
    return found.select(*ids, F.col("__best").alias(r_us), *[F.col(f"__b_{v}").alias(v) for v in values])


def market_response(releases: DataFrame, bars: DataFrame, spec: ResponseSpec = ResponseSpec()) -> DataFrame:
    """A row for each release (release_id, symbol, release_ts; unique ids and symbols) with all features and market_window_status.

    Status: NO_TRUSTED_EVENT_TIMESTAMP, MISSING_MARKET_DATA (no bar in the whole span), NO_BASELINE_BAR, INSUFFICIENT_POST_WINDOW, INSUFFICIENT_PRE_WINDOW, OK.
    """
    key = ["release_id", "symbol"]
    step = long(spec.step_us)
    t = F.unix_micros("release_ts")
    r = releases.select(*key, "release_ts", t.alias("t_us"))
    low = F.col("t_us") - F.pmod(F.col("t_us"), step)
    r = r.withColumn("low", low).withColumn("high", F.when(F.col("low") == F.col("t_us"), F.col("low")).otherwise(F.col("low") + step))
    reach = max(spec.pre, *PRE_HORIZONS) + 1 + spec.lookback
    width = long((reach + spec.post + 2) * spec.step_us)
    # bars by their place on the grid; others meet no release
    us = F.unix_micros("timestamp_utc")
    bar = F.struct(F.call_function("div", us, step).alias("g"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    b = bars.where(F.pmod(us, step) == 0).select(F.col("symbol").alias("b_symbol"), bar.alias("bar"), F.floor(us / width).alias("bucket"))
    # a bucket has as many bars as fit in two widths
    packs = b.withColumn("b_bucket", F.explode(F.array("bucket", F.col("bucket") - 1))).groupBy("b_symbol", "b_bucket").agg(F.array_sort(F.collect_list("bar")).alias("bars"))
    # releases between the same two places see the same bars: these are measured once
    place = ["symbol", "low", "high"]
    timed = r.where("t_us is not null").select(*place).distinct().withColumn("bucket", F.floor((F.col("low") - long(reach * spec.step_us)) / width))
    # the arrays cost more than the places' few bytes: spread over as many tasks as shuffles have
    timed = timed.repartition(int(releases.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place)
    rows = timed.join(packs, (F.col("symbol") == F.col("b_symbol")) & (F.col("bucket") == F.col("b_bucket")), "left")
    # the floor's place, and the ceiling's, which is the same or the next
    rows = rows.withColumn("g0", F.call_function("div", F.col("low"), step)).withColumn("g1", F.call_function("div", F.col("high"), step))
    near = F.filter("bars", lambda x: (x["g"] >= F.col("g0") - reach) & (x["g"] < F.col("g1") + spec.post))
    rows = rows.select(*place, "g0", "g1", F.coalesce(near, F.array()).alias("w"))
    from_floor = lambda first, last: lambda x: x["g"].between(F.col("g0") + first, F.col("g0") + last)
    from_ceiling = lambda n: lambda x: (x["g"] >= F.col("g1")) & (x["g"] < F.col("g1") + n)
    at = lambda i: F.get("w", i)
    steps = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(at(i)["g"].alias("g"), F.when(at(i - 1)["g"] == at(i)["g"] - 1, ln(ratio(at(i)["c"], at(i - 1)["c"]))).alias("r")))
    before = F.filter("w", from_floor(-spec.lookback, -1))
    rows = rows.withColumn("steps", F.when(F.size("w") > 0, steps)).withColumn("base", F.element_at(F.when(F.size(before) > 0, before), -1))
    rows = rows.withColumns({f"post_{n}": F.filter("w", from_ceiling(n)) for n in sorted({spec.post, *EXCURSIONS})} | {"pre_30": F.filter("w", from_floor(-30, -1))})
    total = lambda c, field: F.aggregate(c, F.lit(0.0), lambda s, x: s + x[field])
    full = lambda name, n, c: F.when(F.size(name) == n, c)

    def volatility(n: int, inside) -> Column:
        known = F.filter(F.filter("steps", inside), lambda x: x["r"].isNotNull())
        return F.when(F.size(known) == n, F.sqrt(F.aggregate(known, F.lit(0.0), lambda s, x: s + x["r"] * x["r"])))

    close_at = lambda place: F.get(F.filter("w", lambda x: x["g"] == place), 0)["c"]
    made = {
        "n_any": F.size(F.filter("w", lambda x: x["g"] >= F.col("g0") - (spec.pre + 1 + spec.lookback))),
        "n_pre": F.size(F.filter("w", from_floor(-spec.pre, -1))),
        "n_post": F.size(f"post_{spec.post}"),
        "base_us": F.col("base.g") * step,
        "baseline_price": F.col("base.c"),
        "realized_vol_pre_30m": volatility(30, from_floor(-30, -1)),
        "volume_pre_30m": full("pre_30", 30, total("pre_30", "v")),
    }
    made |= {f"c_{k}": close_at(F.col("g1") + k - 1) for k in POST_HORIZONS}
    made |= {f"before_{k}": close_at(F.col("base.g") - k) for k in PRE_HORIZONS}
    made |= {f"hi_{h}": full(f"post_{h}", h, F.array_max(F.transform(f"post_{h}", lambda x: x["h"]))) for h in EXCURSIONS}
    made |= {f"lo_{h}": full(f"post_{h}", h, F.array_min(F.transform(f"post_{h}", lambda x: x["l"]))) for h in EXCURSIONS}
    made |= {f"rv_{h}": volatility(h, from_ceiling(h)) for h in (30, 60)}
    made |= {f"volume_post_{h}m": full(f"post_{h}", h, total(f"post_{h}", "v")) for h in (30, 60)}
    measured = rows.select(*[F.col(c).alias(f"__{c}") for c in place], *[c.alias(n) for n, c in made.items()])
    same = F.lit(True)
    for c in place:
        same = same & (F.col(c) == F.col(f"__{c}"))
    found = r.join(measured, same, "left")
    has = F.col("base_us").isNotNull()
    with_base = lambda c: F.when(has, c)
    seen = F.coalesce(F.col("n_any"), F.lit(0)) > 0
    px = F.col("baseline_price")
    aligned = F.col("low") == F.col("high")
    out: dict[str, Column] = {}
    for k in PRE_HORIZONS:
        out[f"ret_pre_{k}m"] = ratio(px, F.col(f"before_{k}")) - 1
    for k in POST_HORIZONS:
        out[f"ret_post_{k}m"] = with_base(ratio(F.col(f"c_{k}"), px) - 1)
        out[f"direction_{k}m"] = direction(out[f"ret_post_{k}m"], spec.tolerance)
    for h in EXCURSIONS:
        out[f"max_up_{h}m"] = with_base(ratio(F.col(f"hi_{h}"), px) - 1)
        out[f"max_down_{h}m"] = with_base(ratio(F.col(f"lo_{h}"), px) - 1)
    out["realized_vol_pre_30m"] = with_base(F.col("realized_vol_pre_30m"))
    for h in (30, 60):
        out[f"realized_vol_post_{h}m"] = F.when(has & aligned, F.col(f"rv_{h}"))
        out[f"volume_post_{h}m"] = with_base(F.col(f"volume_post_{h}m"))
    out["volume_pre_30m"] = with_base(F.col("volume_pre_30m"))
    pre_v, post_v = out["volume_pre_30m"], out["volume_post_30m"]
    status = F.when(pre_v.isNull(), "PRE_VOLUME_MISSING").when(post_v.isNull(), "POST_VOLUME_MISSING").when(pre_v == 0, "PRE_VOLUME_ZERO").otherwise("OK")
    out["volume_ratio_30m"] = F.when(has & (status == "OK"), ratio(post_v, pre_v))
    out["volume_ratio_30m_status"] = with_base(status)
    missing_pre, missing_post = F.lit(spec.pre) - F.col("n_pre"), F.lit(spec.post) - F.col("n_post")
    out |= {
        "baseline_found": has,
        "baseline_timestamp_utc": F.timestamp_micros("base_us"),
        "bars_expected": F.lit(spec.pre + spec.post),
        "bars_found": F.when(seen, F.col("n_pre") + F.col("n_post")),
        "missing_pre_bars": F.when(seen, missing_pre),
        "missing_post_bars": F.when(seen, missing_post),
        "missing_bar_count": F.when(seen, missing_pre + missing_post),
        "timestamp_minute_aligned": F.when(F.col("t_us").isNotNull(), aligned),
        "market_window_status": coalesced_status(
            (F.col("t_us").isNull(), "NO_TRUSTED_EVENT_TIMESTAMP"), (~seen, "MISSING_MARKET_DATA"), (~has, "NO_BASELINE_BAR"),
            (missing_post > 0, "INSUFFICIENT_POST_WINDOW"), (missing_pre > 0, "INSUFFICIENT_PRE_WINDOW"), otherwise="OK",
        ),
    }
    return found.select(*key, "release_ts", "baseline_price", *[c.alias(n) for n, c in out.items()])


def all_pairs(releases: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Each release for each of a fixed, short list of symbols."""
    return releases.withColumn("symbol", F.explode(F.array(*map(F.lit, symbols))))
