"""Values, units, rounding and comparison as Column expressions. Missing stays missing; NaN counts as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column) -> Column:
    """NaN to null."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def parse_value(text: Column) -> Column:
    """struct(value, unit) of a displayed number.

    '' and dashes: (null, UNKNOWN). A trailing % makes PERCENT, then K, M, B make THOUSANDS scaled to thousands, a bare number is a
    LEVEL; what has no number is (null, UNKNOWN). Commas are dropped and the first number counts.
    """
    t = F.trim(text)
    percent = t.endswith("%")
    body = F.when(percent, F.trim(F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(t)
    suffix = F.upper(F.substring(body, -1, 1))
    scale = F.when(suffix == "K", F.lit(1.0)).when(suffix == "M", F.lit(1e3)).when(suffix == "B", F.lit(1e6))
    number = F.regexp_extract(F.regexp_replace(body, ",", ""), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    blank = t.isNull() | t.isin("", "-", "—")
    value = F.when(blank, None).when(percent, number).when(scale.isNotNull(), number * scale).otherwise(number)
    unit = F.when(blank | number.isNull(), "UNKNOWN").when(percent, "PERCENT").when(scale.isNotNull(), "THOUSANDS").otherwise("LEVEL")
    return F.struct(value.alias("value"), unit.alias("unit"))


def decimals(x: Column) -> Column:
    """Digits after the point in the shortest decimal form."""
    d = F.abs(x).cast("string").cast("decimal(38,18)")
    return F.length(F.rtrim(F.split_part(d.cast("string"), F.lit("."), F.lit(2)), F.lit("0")))


def half_up(x: Column, digits: Column) -> Column:
    """Decimal rounding, halves away from zero, at 0 to 9 digits. Cases with few digits come first, as each case asks for digits anew; callers make these a column of their own."""
    d = x.cast("string").cast("decimal(38,18)")
    out = F.when(digits == 0, F.round(d, 0).cast("double"))
    for k in range(1, 10):
        out = out.when(digits == k, F.round(d, k).cast("double"))
    return out.otherwise(F.round(d, 0).cast("double"))


def compare_displayed(shown: Column, official: Column, min_digits: int = 1) -> Column:
    """EXACT_MATCH within 1e-9, ROUNDING_MATCH if the official value rounds half up to the shown one, else VALUE_MISMATCH; null if either is missing."""
    digits = F.greatest(F.lit(min_digits), decimals(shown))
    rounded = half_up(official, digits)
    return (
        F.when(shown.isNull() | official.isNull(), None)
        .when(F.abs(shown - official) <= 1e-9, "EXACT_MATCH")
        .when(F.abs(rounded - shown) <= 1e-9, "ROUNDING_MATCH")
        .otherwise("VALUE_MISMATCH")
    )


def official_status(official: Column, shown: Column, official_unit: Column, shown_unit: Column) -> Column:
    """A status for each way the comparison can be missing, else its outcome."""
    known = (official_unit == shown_unit) & (official_unit != "UNKNOWN")
    return (
        F.when(official.isNull(), "no_official_release_vintage")
        .when(shown.isNull(), "no_calendar_actual")
        .when(~F.coalesce(known, F.lit(False)), "not_comparable_units")
        .otherwise(F.lower(compare_displayed(shown, official)))
    )


def direction(ret: Column, tolerance: float = 1e-12) -> Column:
    """1, -1, or 0 within the tolerance."""
    return F.when(F.abs(ret) <= tolerance, 0).otherwise(F.signum(ret).cast("int"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def float_ratio(a: Column, b: Column) -> Column:
    """a / b as floats have it: infinite, or NaN for 0 / 0, where b is 0."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(ratio(a, b))


def ln(x: Column) -> Column:
    """Natural logarithm as floats have it: -inf of 0 and NaN below, where Spark's is null. Null stays null."""
    return F.coalesce(F.ln(x), F.when(x == 0, float("-inf")).when(x < 0, float("nan")))


def pearson(x: str, y: str, flat: float | None = None) -> Column:
    """Correlation over rows where both are present; `flat` instead of an error for constant columns, null without rows. NaN if a value is not finite."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    covariance = F.covar_pop(a, b)
    return F.when(covariance.isNotNull(), F.coalesce(F.try_divide(covariance, F.stddev_pop(a) * F.stddev_pop(b)), F.lit(flat)))


def coalesced_status(*cases: tuple[Column, str], otherwise: str) -> Column:
    """The first case that holds names the status."""
    out = F.lit(otherwise)
    for condition, name in reversed(cases):
        out = F.when(condition, name).otherwise(out)
    return out
