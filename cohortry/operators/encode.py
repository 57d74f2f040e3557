"""Label encodings and per-dataset overrides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.numeric import flag
from cohortry.operators.ranks import global_rank


def collapse_target(col: Column) -> Column:
    """0 stays 0; every other value, and an unknown one, becomes 1."""
    return F.when(col == 0, 0).otherwise(1)


def first_seen_codes(df: DataFrame, col: str, order_key: str, out: str) -> DataFrame:
    """One row per distinct value with its code by first appearance; The distinct values
    are ranked by a distributed sort, so there may be many."""
    firsts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.min(order_key).alias("__first"))
    coded = global_rank(firsts, ["__first", col], out="__n")
    return coded.select(col, (F.col("__n") - 1).cast("bigint").alias(out))


def factorize(df: DataFrame, col: str, order_key: str, out: str) -> DataFrame:
    """Label codes by first appearance, -1 for null."""
    codes = first_seen_codes(df, col, order_key, "__code")
    return df.join(codes, col, "left").withColumn(out, F.coalesce("__code", F.lit(-1).cast("bigint"))).drop("__code")


def encode_yes_no(df: DataFrame, cols: Sequence[str], order_key: str) -> DataFrame:
    """Columns that mention Yes/No become 0/1, the others label codes."""
    probe = df.agg(*[F.bool_or(F.col(c).rlike("Yes|No")).alias(c) for c in cols]).first()
    out = df
    for c in cols:
        if probe[c]:
            out = out.withColumn(c, flag(F.col(c) == "Yes").cast("bigint"))
        else:
            out = factorize(out, c, order_key, "__new").drop(c).withColumnRenamed("__new", c)
    return out.select(*df.columns)


def apply_overrides(df: DataFrame, overrides: Mapping, target: str) -> DataFrame:
    """Target transform, per-column imputation and column drop of one dataset."""
    from cohortry.operators.preprocess import fit_imputer

    if overrides.get("target_transform") == "collapse":
        df = df.withColumn(target, collapse_target(F.col(target)))
    for col, strategy in (overrides.get("impute") or {}).items():
        df = fit_imputer(df, [col], strategy).transform(df)
    return df.drop(*(overrides.get("drop") or []))
