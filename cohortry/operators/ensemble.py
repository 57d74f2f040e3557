"""Voting over class-probability arrays ordered by class label."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_voting(kind: str) -> str:
    if kind not in ("soft", "hard"):
        raise ValueError(f"voting must be 'soft' or 'hard', got {kind!r}")
    return kind


def margin_probabilities(s: Column) -> Column:
    """softmax([-s, s]) for learners that give only a margin."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * s))
    return F.array(1 - p, p)


def soft_vote(probs: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """Weighted mean of the probability arrays."""
    w = list(weights or [1.0] * len(probs))
    total = sum(w)

    def scale(p: Column, share: float) -> Column:
        return F.transform(p, lambda x: x * F.lit(share))

    scaled = [scale(p, wi / total) for p, wi in zip(probs, w)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), scaled)


def argmax(p: Column) -> Column:
    """0-based position of the largest probability, the first on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def hard_vote(labels: Sequence[Column]) -> Column:
    """Majority label, the smallest on ties."""
    votes = F.array(*labels)
    counted = F.transform(
        F.array_distinct(votes), lambda v: F.struct((-F.size(F.filter(votes, lambda x: x == v))).alias("n"), v.alias("label"))
    )
    return F.array_min(counted)["label"]
