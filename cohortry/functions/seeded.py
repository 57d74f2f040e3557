"""Seeded randomness as pure column expressions, the same on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: str, *cols: Column | str) -> Column:
    """A 32-bit unsigned integer (bigint) from md5(col|col|...|seed)."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    text = F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def seeded_uniform(seed: str, *cols: Column | str) -> Column:
    """A double in (0, 1)."""
    return (seeded_hash(seed, *cols).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def seeded_normal(seed: str, *cols: Column | str) -> Column:
    """Standard normal by Box-Muller from two seeded uniforms."""
    u1 = seeded_uniform(seed + "a", *cols)
    u2 = seeded_uniform(seed + "b", *cols)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)
