"""Text features as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# whitespace as text tools see it: ASCII, separators, next-line and unit separators
WS = r"[\s\x0B\x1c-\x1f\x85\p{Z}]+"


def clean(col: Column) -> Column:
    """Null becomes empty; surrounding whitespace goes."""
    return F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), f"^{WS}|{WS}$", "")


def tokens(col: Column) -> Column:
    return F.filter(F.split(col, WS), lambda x: x != F.lit(""))


def word_count(col: Column) -> Column:
    return F.coalesce(F.size(tokens(col)), F.lit(0))


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer, lengths clipped at one."""
    la, lb = F.greatest(a, F.lit(1)), F.greatest(b, F.lit(1))
    return F.least(la, lb) / F.greatest(la, lb)


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the lower-cased token sets; 0 when either is empty."""
    sa, sb = F.array_distinct(tokens(F.lower(a))), F.array_distinct(tokens(F.lower(b)))
    shared = F.size(F.array_intersect(sa, sb))
    return F.when((F.size(sa) == 0) | (F.size(sb) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(sa) + F.size(sb) - shared)
    )


def normalized_names(names: list[str]) -> list[str]:
    return [n.replace("-", "_").replace(" ", "_").lower() for n in names]
