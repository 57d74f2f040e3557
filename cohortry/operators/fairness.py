"""Group metrics of a scored table and their gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.numeric import numeric_columns
from cohortry.operators.metrics import ranking_scores
from cohortry.operators.ranks import exact_quantiles


def group_scores(df: DataFrame, sensitive: Sequence[str], y: str, p: str) -> DataFrame:
    """feature, grp, size, positive_rate, roc_auc, pr_auc for all sensitive columns in
    one pass. Numeric columns split above their median; one-class groups drop out."""
    numeric = [c for c in numeric_columns(df) if c in sensitive]
    med = {}
    if numeric:  # one value per numeric column
        med = {r["feature"]: r["q0"] for r in exact_quantiles(df, numeric, [0.5]).collect()}
    cells = []
    for c in sensitive:
        g = F.when(F.col(c) > F.lit(med[c]), "1").otherwise("0") if c in med else F.col(c).cast("string")
        cells.append(F.struct(F.lit(c).alias("feature"), g.alias("grp")))
    keyed = df.select(y, p, F.explode(F.array(*cells)).alias("g")).select("g.feature", "g.grp", y, p)
    s = ranking_scores(keyed, y, p, ["feature", "grp"]).filter(F.col("roc_auc").isNotNull())
    return s.select(
        "feature", "grp", F.col("n").alias("size"), (F.col("n_positive") / F.col("n")).alias("positive_rate"), "roc_auc", "pr_auc"
    )


def disparities(groups: DataFrame) -> DataFrame:
    """max - min of a metric over the groups of a feature, when there are two or more."""
    gap = lambda c: F.max(c) - F.min(c)
    return (
        groups.groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("n_groups"),
            gap("roc_auc").alias("roc_auc_disparity"),
            gap("positive_rate").alias("positive_rate_disparity"),
            gap("roc_auc").alias("equalized_odds"),
        )
        .filter("n_groups >= 2")
    )
