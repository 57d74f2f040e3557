"""Keyed lookups against side tables whose size is checked before a broadcast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the plan itself proves the bound on the rows.

    Otherwise the join strategy stays with Catalyst and AQE, which look at the
    real size."""
    stats = df._jdf.queryExecution().optimizedPlan().maxRows()
    if stats.isDefined() and stats.get() <= max_rows:
        return F.broadcast(df)
    return df


def lookup(
    df: DataFrame, side: DataFrame, on: Sequence[str], defaults: Mapping[str, Column]
) -> DataFrame:
    """Left join with a default for missing keys. Catalyst broadcasts the side when
    its size allows, and shuffles both sides otherwise."""
    out = df.join(maybe_broadcast(side), list(on), "left")
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def literal_table(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small fixed table as plan literals (no Python workers, no driver data)."""
    from pyspark.sql import types as T

    fields = T._parse_datatype_string(schema).fields
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields)]) for r in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
