"""Sequential ids in a given order without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from cohortry.operators.ranks import global_rank


def sequential_id(df: DataFrame, order: Sequence[str | Column], out: str = "id") -> DataFrame:
    """1..n in `order`; wherever the rows crowd, the range partitions follow them."""
    return global_rank(df, order, out=out)
