"""Result tables: means, best model, readiness, run log and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def group_means(results: DataFrame, groupings: Mapping[str, str], metric: str) -> DataFrame:
    """Mean of a metric by each grouping column, best first within a grouping."""
    out = None
    for label, col in groupings.items():
        g = results.groupBy(F.col(col).alias("name")).agg(
            F.avg(metric).alias("mean_value"), F.count(F.lit(1)).alias("n")
        )
        g = g.select(F.lit(label).alias("grouping"), "name", "mean_value", "n")
        out = g if out is None else out.unionByName(g)
    return out.orderBy("grouping", F.desc("mean_value"))


def composite_score() -> Column:
    """ROC AUC + PR AUC - Brier; missing values count 0, 0 and 1."""
    return F.coalesce("roc_auc", F.lit(0.0)) + F.coalesce("pr_auc", F.lit(0.0)) - F.coalesce("brier_score", F.lit(1.0))


def best_model(metrics: DataFrame, order: str = "model") -> DataFrame:
    """The model with the largest composite score above -1; the first in order on ties."""
    m = metrics.withColumn("composite_score", composite_score()).filter("composite_score > -1")
    return m.orderBy(F.desc("composite_score"), order).limit(1)


def recommendation_lines(metrics: DataFrame, disparities: DataFrame) -> DataFrame:
    """kind, model, recommendation: deploy the best, review unfair ones, calibrate."""
    f3 = lambda c: F.format_string("%.3f", F.col(c))
    deploy = best_model(metrics).select(
        F.lit("deploy").alias("kind"), "model",
        F.concat(F.lit("Deploy "), "model", F.lit(" as primary model (ROC-AUC: "), f3("roc_auc"), F.lit(")")).alias("recommendation"),
    )
    review = disparities.filter("roc_auc_disparity > 0.1").select(
        F.lit("review").alias("kind"), "model",
        F.concat(
            F.lit("Review "), "model", F.lit(" for fairness issues in "), "feature", F.lit(" (disparity: "), f3("roc_auc_disparity"), F.lit(")")
        ).alias("recommendation"),
    )
    calibrate = metrics.filter("brier_score > 0.25").select(
        F.lit("calibrate").alias("kind"), "model",
        F.concat(F.lit("Consider calibrating "), "model", F.lit(" (Brier score: "), f3("brier_score"), F.lit(")")).alias("recommendation"),
    )
    return deploy.unionByName(review).unionByName(calibrate)


def production_readiness(metrics: DataFrame, min_auc: float = 0.75, min_accuracy: float = 0.70, max_brier: float = 0.25) -> DataFrame:
    """Flags and advice per model. Stability is always met, as no score history is kept."""
    auc, brier = F.col("roc_auc"), F.col("brier_score")
    ready = (auc >= min_auc) & (F.col("accuracy") >= min_accuracy) & (brier <= max_brier)
    advice = F.array_compact(
        F.array(
            F.when(~ready & (auc < min_auc), F.concat(F.lit("Improve ROC-AUC from "), F.format_string("%.3f", auc), F.lit(f" to >{min_auc}"))),
            F.when(~ready & (brier > max_brier), F.concat(F.lit("Improve calibration (Brier score: "), F.format_string("%.3f", brier), F.lit(")"))),
            F.when(ready, F.lit("✅ Ready for production deployment")),
        )
    )
    return metrics.select(
        "*", ready.alias("meets_performance_criteria"), F.lit(True).alias("meets_stability_criteria"), ready.alias("production_ready"),
        advice.alias("recommendations"),
    )


def training_summary(metrics: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Models trained, models that meet the threshold, best by AUC."""
    return metrics.groupBy().agg(
        F.count(F.lit(1)).alias("n_models"),
        F.count_if(F.col("roc_auc") >= threshold).alias("n_meeting_threshold"),
        F.min_by("model", F.struct(-F.col("roc_auc"), "model")).alias("best_model"),
        F.max("roc_auc").alias("best_roc_auc"),
    )


def cross_dataset_summary(results: DataFrame, metric: str = "accuracy", top: int = 10) -> DataFrame:
    """section, name, value: totals, top results, means by model and by dataset."""
    v = F.col(metric)
    totals = results.groupBy().agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("dataset").alias("d"), F.count_distinct("model").alias("m")
    )
    lines = F.array(
        *[F.struct(F.lit("total").alias("section"), F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for n, c in (("runs", "n"), ("datasets", "d"), ("models", "m"))]
    )
    out = totals.select(F.inline(lines))
    head = results.orderBy(F.desc(metric), "dataset", "model").limit(top)
    out = out.unionByName(head.select(F.lit("top").alias("section"), F.concat_ws("/", "dataset", "model").alias("name"), v.alias("value")))
    means = group_means(results, {"by_model": "model", "by_dataset": "dataset"}, metric)
    return out.unionByName(means.select(F.col("grouping").alias("section"), "name", F.col("mean_value").alias("value")))


# ------------------------------------------------------------------- run log
def metric_key(col: Column) -> Column:
    """Metric names hold letters, digits, dot, dash, underscore, slash and space."""
    return F.regexp_replace(col, r"[^A-Za-z0-9_./ -]", "_")


def log_rows(values: DataFrame, run_id: Column, ts: Column, kind: str, prefix: str = "") -> DataFrame:
    """values: key, value -> the log layout (run_id, ts, kind, key, value)."""
    return values.select(
        run_id.alias("run_id"), ts.alias("ts"), F.lit(kind).alias("kind"), metric_key(F.concat(F.lit(prefix), F.col("key"))).alias("key"),
        F.col("value").cast("string").alias("value"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1) -> DataFrame:
    """The newest n rows per key: latest run by name, latest version per stage, kept runs."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def explanation_report(importances: DataFrame, risk: DataFrame, top: int = 5) -> DataFrame:
    """section, name, detail: leading features and the risk analysis."""
    head = importances.orderBy(F.desc("importance"), "feature").limit(top)
    a = head.select(F.lit("top_features").alias("section"), F.col("feature").alias("name"), F.format_string("%.4f", "importance").alias("detail"))
    b = risk.select(F.lit("clinical_analysis").alias("section"), F.col("aspect").alias("name"), F.col("finding").alias("detail"))
    return a.unionByName(b)


def registration_summary(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
