"""Table checks and profiles. Schema questions are answered from the schema; data
questions share one aggregate pass over all columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.functions.numeric import numeric_columns, string_columns
from cohortry.operators.lookup import literal_table
from cohortry.operators.preprocess import long_form
from cohortry.operators.ranks import exact_quantiles
from cohortry.session import checkpoint

TARGET_NAMES = ("target", "diagnosis", "label", "class")


@dataclass(frozen=True)
class Validation:
    valid: bool
    issues: tuple[str, ...]


def validate(df: DataFrame, required: Sequence[str] = (), target: str | None = None) -> Validation:
    """Required columns, target and emptiness."""
    issues = []
    missing = [c for c in required if c not in df.columns]
    if missing:
        issues.append(f"missing required columns: {', '.join(missing)}")
    if target and target not in df.columns:
        issues.append(f"target column not found: {target}")
    if df.isEmpty():
        issues.append("dataset is empty")
    return Validation(not issues, tuple(issues))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows beyond the first of each identical group; nulls are equal."""
    sizes = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return sizes.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def null_profile(df: DataFrame) -> DataFrame:
    """column, dtype, n_rows, n_null: one pass over all columns."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"x{i}") for i, c in enumerate(df.columns)])
    lines = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col("n").alias("n_rows"), F.col(f"x{i}").alias("n_null"))
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return row.select(F.inline(F.array(*lines)))


def load_profile(df: DataFrame) -> DataFrame:
    """Load-time metadata: position, column, dtype, row and null counts."""
    lit_pos = {c: i for i, c in enumerate(df.columns)}
    pos = F.create_map(*[F.lit(x) for kv in lit_pos.items() for x in kv])
    return null_profile(df).withColumn("position", F.element_at(pos, F.col("column")))


def sparse_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Null counts with a warning where strictly more than the threshold is null."""
    share = F.when(F.col("n_rows") > 0, F.col("n_null") / F.col("n_rows")).otherwise(F.lit(0.0))
    return null_profile(df).select("column", "n_null", share.alias("null_share"), (share > threshold).alias("warning"))


def totals(df: DataFrame) -> DataFrame:
    """Rows, columns, and how many columns are numeric and textual."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(len(numeric_columns(df))).alias("n_numeric"),
        F.lit(len(string_columns(df))).alias("n_categorical"),
    )


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std (sample), min, quartiles and max per numeric column."""
    cols = list(cols or numeric_columns(df))
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [
            F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
            F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
        ]
    lines = [
        F.struct(
            F.lit(c).alias("feature"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
            F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
        )
        for i, c in enumerate(cols)
    ]
    base = df.agg(*aggs).select(F.inline(F.array(*lines)))
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75]).withColumnsRenamed({"q0": "q25", "q1": "q50", "q2": "q75"})
    return base.join(q, "feature", "left")


def describe_categorical(df: DataFrame, cols: Sequence[str] | None = None, top: int = 5) -> DataFrame:
    """Per text column: distinct values, and the top values by count (ties: smallest)."""
    cols = list(cols or string_columns(df))
    counts = (
        long_form(df, cols, "string").filter(F.col("v").isNotNull())
        .groupBy("feature", F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    )
    distinct = counts.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode")
    )
    w = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    head = counts.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= top)
    return head.join(distinct, "feature")


def audit_columns(df: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Per column: null share (4 digits), all-null, over-threshold and repeated-name flags."""
    repeated = [c for c, n in Counter(df.columns).items() if n > 1]
    if repeated:
        df = df.toDF(*[f"{c}.{i}" if c in repeated else c for i, c in enumerate(df.columns)])
    share = F.when(F.col("n_rows") > 0, F.round(F.col("n_null") / F.col("n_rows"), 4)).otherwise(F.lit(0.0))
    base = F.regexp_replace("column", r"\.\d+$", "")
    return null_profile(df).select(
        "column", "n_rows", "n_null", share.alias("null_share"),
        (F.col("n_null") == F.col("n_rows")).alias("all_null"),
        (share > threshold).alias("over_threshold"),
        base.isin(repeated).alias("repeated_name") if repeated else F.lit(False).alias("repeated_name"),
    )


def audit_table(df: DataFrame, name: str, threshold: float = 0.4) -> DataFrame:
    """One row per table: rows, nulls, status ok | schema_warning | empty."""
    bad = F.bool_or(F.col("all_null") | F.col("repeated_name"))
    return audit_columns(df, threshold).groupBy().agg(
        F.lit(name).alias("name"),
        F.max("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_columns"),
        F.sum("n_null").alias("n_null"),
        F.count_if("over_threshold").alias("columns_over_threshold"),
        F.when(F.max("n_rows") == 0, "empty").when(bad, "schema_warning").otherwise("ok").alias("status"),
    )


def audit_summary(audits: DataFrame) -> DataFrame:
    return audits.groupBy("status").agg(F.count(F.lit(1)).alias("n_tables"), F.sum("n_null").alias("total_nulls"))


def find_target(columns: Sequence[str]) -> str | None:
    return next((c for c in TARGET_NAMES if c in columns), None)


def target_distribution(df: DataFrame, target: str | None = None, warn_ratio: float | None = None) -> DataFrame:
    """value, n, share of the (discovered) target, with the imbalance ratio and warning.
    Null counts as a value of its own."""
    target = target or find_target(df.columns)
    if target is None:
        raise ValueError(f"no target column among {', '.join(TARGET_NAMES)}")
    counts = checkpoint(df.groupBy(F.col(target).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")))
    whole = counts.agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("k")).first()
    of_all = {c: F.lit(whole[c]).cast("bigint") for c in ("hi", "lo", "all", "k")}  # one row, whatever the number of values
    out = counts.select(
        "value", "n", (F.col("n") / of_all["all"]).alias("share"), F.round(of_all["hi"] / of_all["lo"], 4).alias("imbalance_ratio"),
        of_all["k"].alias("n_values"),
    )
    warn = F.lit(False) if warn_ratio is None else (F.col("n_values") >= 2) & (F.col("imbalance_ratio") >= warn_ratio)
    return out.withColumn("imbalance_warning", warn)


def class_percentages(df: DataFrame, target: str) -> DataFrame:
    """Count and percentage per class; there may be many classes."""
    counts = checkpoint(df.groupBy(F.col(target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0]
    return counts.withColumn("percentage", F.col("n") * 100.0 / F.lit(total))


class FeatureMismatch(ValueError):
    """Input columns differ from the fitted features."""


def schema_differences(columns: Sequence[str], expected: Sequence[str]) -> dict[str, list[str]]:
    return {
        "missing": [c for c in expected if c not in columns],
        "extra": [c for c in columns if c not in expected],
    }


def require_features(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Strict check before scoring."""
    diff = schema_differences(df.columns, expected)
    if diff["missing"] or diff["extra"] or len(df.columns) != len(expected):
        raise FeatureMismatch(
            f"expected {len(expected)} features, got {len(df.columns)}; missing={diff['missing']}; extra={diff['extra']}"
        )
    return df.select(*expected)


def align_features(df: DataFrame, expected: Sequence[str], fill: float | None = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """Training order, unknown columns dropped, missing ones filled, all double."""

    def one(c: str) -> Column:
        if c in df.columns:
            v = F.col(c).try_cast("double")
            return (v if fill is None else F.coalesce(v, F.lit(fill))).alias(c)
        return F.lit(fill).cast("double").alias(c)

    return df.select(*keep, *[one(c) for c in expected])


def manifest(parts: Mapping[str, tuple[DataFrame, Mapping]]) -> DataFrame:
    """One row per non-empty dataset: rows, columns, target, type, classes, description."""
    rows = []
    for name, (df, meta) in parts.items():
        target = meta.get("target", "unknown")
        classes = F.count_distinct(target) if target in df.columns else F.lit(None).cast("bigint")
        rows.append(
            df.agg(F.count(F.lit(1)).alias("n_rows"), classes.alias("n_classes")).select(
                F.lit(name).alias("dataset"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
                F.lit(target).alias("target"), F.lit(meta.get("type", "unknown")).alias("type"), "n_classes",
                F.lit(meta.get("description", "No description")).alias("description"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), rows).filter("n_rows > 0")


def inventory_rollup(inv: DataFrame, kind: str, location: str, size: str) -> DataFrame:
    """Count and size by type, by location and in total."""
    scope = (
        F.when((F.grouping(kind) == 1) & (F.grouping(location) == 1), "total").when(F.grouping(kind) == 0, "type").otherwise("location")
    )
    k, loc = F.col(kind), F.col(location)
    return inv.groupingSets([[k], [loc], []], k, loc).agg(
        scope.alias("scope"), F.count(F.lit(1)).alias("n"), F.sum(size).alias("total_size")
    ).select("scope", F.coalesce(k, loc, F.lit("all")).alias("name"), "n", "total_size")


def issue_rows(spark, name: str, v: Validation) -> DataFrame:
    return literal_table(spark, [(name, v.valid, "; ".join(v.issues))], "name string, valid boolean, issues string")
