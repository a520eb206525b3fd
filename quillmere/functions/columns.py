"""Column builders: missing values, arrays, safe arithmetic, binning. All stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def sentinel_to_null(x: Column, sentinel: float = -1) -> Column:
    """Labels tables write -1 (or NaN) for a missing cell."""
    return F.when((x != sentinel) & ~F.isnan(x.cast("double")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0; ANSI mode would fail."""
    return F.try_divide(a, b)


def tidy(x: Column, digits: int = 6) -> Column:
    """A result rounded for comparison between engines, never -0."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def nearest_quantile(values: Column, q: float) -> Column:
    """The element of a sorted copy at the nearest rank to q (n - 1); NULL elements are left out."""
    own = F.sort_array(F.filter(values, lambda v: v.isNotNull()))
    return F.when(F.size(own) > 0, F.element_at(own, (F.floor(F.lit(float(q)) * (F.size(own) - 1) + 0.5) + 1).cast("int")))


def array_total(values: Column) -> Column:
    """Sum that skips NULL elements; 0 for an empty array."""
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)))


def array_mean(values: Column) -> Column:
    own = F.filter(values, lambda v: v.isNotNull())
    return ratio(array_total(own), F.size(own).cast("double"))


def circular_sums(values: Column, width: int, period: int = 24) -> Column:
    """Sums over `width` neighbours from each place on, wrapping round."""
    twice = F.concat(values, values)
    return F.transform(F.sequence(F.lit(1), F.lit(period)), lambda s: array_total(F.slice(twice, s, width)))


def first_index(values: Column, wanted: Column) -> Column:
    """Zero-based place of the first element equal to wanted; NULL if there is none."""
    at = F.array_position(values, wanted)
    return F.when(at > 0, at - 1)


def zero_to_missing(values: Column, rule: str, least: float = 180.0, strict: bool = False) -> Column:
    """Zeros that mean missing, by kind of channel.

    each: every 0; whole: all or nothing (an array of zeros only is missing); sleep: zeros are missing where the sum is
    under `least` (with strict, only if it is also over 0); keep: none.
    """
    void = F.transform(values, lambda v: F.when(v != 0, v))
    if rule == "each":
        return void
    if rule == "whole":
        return F.when(F.forall(values, lambda v: v.isNull() | (v == 0)), F.transform(values, lambda v: F.lit(None).cast("double"))).otherwise(values)
    if rule == "sleep":
        low = array_total(values) < least
        return F.when(low & (array_total(values) > 0) if strict else low, void).otherwise(values)
    if rule == "keep":
        return values
    raise ValueError(f"unknown rule {rule!r}")


def age_band(age: Column, young: str = "unknown") -> Column:
    """Bands of ten years from 18 to 60 and over. Tracks differ in what they call the under-18s."""
    return F.when(age.isNull(), "unknown").when(age < 18, young).when(age < 30, "18-29").when(age < 40, "30-39").when(age < 50, "40-49").when(age < 60, "50-59").otherwise("60+")


def whole_years(start: Column, end: Column) -> Column:
    """Birthdays of one date up to another; negative, and as many, where end comes first. That of 29 February comes on 1 March in common years."""
    early, late = F.least(start, end), F.greatest(start, end)
    place = lambda d: F.month(d) * 32 + F.dayofmonth(d)
    years = F.year(late) - F.year(early) - (place(late) < place(early)).cast("int")
    return F.when(end < start, -years).when(end >= start, years)


def skill_ratio(error: Column, base: Column, low: float = 0.01, high: float = 100.0) -> Column:
    """Error over the baseline's, held within [low, high]; NULL where the baseline's is not positive."""
    return F.when(base > 0, F.greatest(F.lit(low), F.least(F.lit(high), error / base)))


def geomean(x: Column) -> Column:
    return F.exp(F.avg(F.log(x)))


def metric_to_error(metric: Column, higher_is_better: Column, floor: float = 0.005) -> Column:
    """Errors from metrics: lower-is-better ones that are not negative stay, higher-is-better ones in [0, 1] are turned."""
    return F.when(higher_is_better & (metric >= 0) & (metric <= 1), F.greatest(1 - metric, F.lit(floor))).when(~higher_is_better & (metric >= 0), metric)


def one_hot(values: Column, options: list) -> dict[str, Column]:
    return {str(o): F.coalesce(F.array_contains(values, o), F.lit(False)) for o in options}


def enforce_bool(x: Column) -> Column:
    """Booleans from the tokens that questionnaires use; anything else is NULL."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("1", "1.0", "true", "yes", "male"), True).when(t.isin("0", "0.0", "false", "no", "female"), False)


def enforce_int(x: Column) -> Column:
    """Whole numbers only; 2.5 is NULL."""
    d = x.cast("string").try_cast("double")
    return F.when(d == F.floor(d), d.cast("long"))


def seed_of(*parts: Column, bits: int = 31) -> Column:
    """A seed from the SHA-256 of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long").bitwiseAND((1 << bits) - 1)
