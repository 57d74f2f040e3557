"""Numeric, time and flag expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_MICROS = 86400e6


def flag(cond: Column) -> Column:
    """0/1 flag; an unknown comparison counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def to_number(col: Column) -> Column:
    """Numeric coercion; unparsable text becomes null."""
    return col.try_cast("double")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def days_between(start: Column, end: Column) -> Column:
    """Whole days, floored (negative gaps round away from zero)."""
    return F.floor((micros(end) - micros(start)) / F.lit(DAY_MICROS))


def duration_days(start: Column, stop: Column) -> Column:
    """Fractional days; an open interval counts 0."""
    return F.coalesce((micros(stop) - micros(start)) / F.lit(DAY_MICROS), F.lit(0.0))


def span_days(first: Column, last: Column) -> Column:
    return F.greatest(F.coalesce(days_between(first, last), F.lit(0)), F.lit(0)).cast("bigint")


def age_years(birth: Column, reference: Column, as_of: Column) -> Column:
    """Age at the reference date, or at `as_of` where there is none."""
    return F.coalesce(
        F.round(days_between(birth, F.coalesce(reference, as_of)) / F.lit(365.25), 1), F.lit(0.0)
    )


def zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def complexity_score(encounters: Column, chronic: Column, active: Column) -> Column:
    return F.round(F.log1p(zero(encounters) + zero(chronic) * 1.5 + zero(active)), 3)


def high_utilization(encounters: Column, chronic: Column, active: Column, span: Column) -> Column:
    return flag(
        (zero(encounters) >= 5) | (zero(chronic) >= 3) | (zero(active) >= 4) | (zero(span) >= 365)
    )


def rescale_clip(x: Column, scale: float, shift: float, lo: float, hi: float, digits: int = 1) -> Column:
    """Affine map, clipped, rounded half to even."""
    return F.bround(F.least(F.greatest(x * scale + shift, F.lit(lo)), F.lit(hi)), digits)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)


def array_std(a: Column) -> Column:
    """Population standard deviation of an array."""
    m = array_mean(a)
    return F.sqrt(
        F.aggregate(
            F.transform(a, lambda x: (x.cast("double") - m) * (x.cast("double") - m)),
            F.lit(0.0),
            lambda s, x: s + x,
        )
        / F.size(a)
    )


def within_size(col: Column, limit_gb: float) -> Column:
    """Keep human-readable sizes: `< 1 ..`, any MB, or `N .. GB` up to the limit."""
    gb = F.regexp_extract(col, r"(\d+).*GB", 1).try_cast("double")
    return F.coalesce(col.rlike("(?i)< 1|MB"), F.lit(False)) | F.coalesce(gb <= limit_gb, F.lit(False))


def within_hours(col: Column, limit_hours: float) -> Column:
    hours = F.regexp_extract(col, r"(\d+).*hour", 1).try_cast("double")
    return F.coalesce(col.rlike("(?i)min"), F.lit(False)) | F.coalesce(hours <= limit_hours, F.lit(False))


def symptom_target(df: DataFrame, symptoms: Sequence[str]) -> Column:
    """A covid/positive column if the table has one, else two or more symptoms."""
    named = [c for c in df.columns if "covid" in c.lower() or "positive" in c.lower()]
    if named:
        return F.col(named[0]).cast("int")
    total = reduce(lambda a, b: a + b, [zero(F.col(c)) for c in symptoms])
    return flag(total >= 2)


def bin_of(x: Column, cuts: Sequence[float], first: int = 0) -> Column:
    """How many of the sorted `cuts` lie below x, by binary search; NaN is above all."""
    if not len(cuts):
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(x <= F.lit(cuts[mid]), bin_of(x, cuts[:mid], first)).otherwise(bin_of(x, cuts[mid + 1 :], first + mid + 1))
