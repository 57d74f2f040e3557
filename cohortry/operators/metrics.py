"""Classification metrics from counts and from cumulative sums over distinct scores.

Everything is keyed: one pass evaluates all models, groups or repeats at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.operators.ranks import running_totals, small_side


def _safe(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def confusion(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, truth, pred, n and the share of the true class."""
    c = df.groupBy(*keys, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "truth")))


def class_report(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, label, precision, recall, f1, support per class of truth or prediction."""
    keys = list(keys)
    c = df.groupBy(*keys, F.col(truth).alias("__t"), F.col(pred).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    sides = F.array(
        F.struct(F.col("__t").alias("label"), F.col("__n").alias("s"), F.lit(0).cast("bigint").alias("q")),
        F.struct(F.col("__p").alias("label"), F.lit(0).cast("bigint").alias("s"), F.col("__n").alias("q")),
    )
    hit = F.when(F.col("__t") == F.col("__p"), F.col("side.s")).otherwise(0)
    per = (
        c.select(*keys, "__t", "__p", F.explode(sides).alias("side"))
        .groupBy(*keys, F.col("side.label").alias("label"))
        .agg(F.sum("side.s").alias("support"), F.sum("side.q").alias("predicted"), F.sum(hit).alias("tp"))
    )
    p, r = _safe(F.col("tp"), F.col("predicted")), _safe(F.col("tp"), F.col("support"))
    return per.select(*keys, "label", p.alias("precision"), r.alias("recall"), _safe(2 * p * r, p + r).alias("f1"), "support", "tp")


def summary_scores(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """accuracy and the weighted and macro precision, recall and f1."""
    rep = class_report(df, truth, pred, keys)
    w = F.sum("support")
    aggs = [(F.sum("tp") / w).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        aggs += [
            (F.sum(F.col(m) * F.col("support")) / w).alias(f"{m}_weighted"),
            F.avg(m).alias(f"{m}_macro"),
        ]
    return rep.groupBy(*keys).agg(*aggs, w.alias("n"))


def binary_rates(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sensitivity and specificity of 0/1 labels."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    c = df.groupBy(*keys).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"),
        F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
    )
    return c.select(
        "*",
        _safe(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"),
        _safe(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
    )


def score_curve(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), times: str | None = None) -> DataFrame:
    """One row per (key, distinct score), descending: cumulative true and false
    positives and the totals of the key. `times` names a column of row counts."""
    n = F.lit(1) if times is None else F.col(times)
    counted = df.select(*keys, F.col(p).alias("score"), (F.col(y).cast("bigint") * n).alias("pos"), n.cast("bigint").alias("n"))
    run = running_totals(counted, "score", ["pos", "n"], keys, descending=True)
    return run.select(
        *keys, "score", "pos", (F.col("n") - F.col("pos")).alias("neg"),
        F.col("cum_pos").alias("tp"), (F.col("cum_n") - F.col("cum_pos")).alias("fp"),
        F.col("tot_pos").alias("p_total"), (F.col("tot_n") - F.col("tot_pos")).alias("n_total"),
    )


def curve_points(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall points per distinct threshold."""
    c = score_curve(df, y, p, keys)
    return c.select(
        *keys, F.col("score").alias("threshold"), "tp", "fp",
        _safe(F.col("tp"), F.col("p_total")).alias("tpr"),
        _safe(F.col("fp"), F.col("n_total")).alias("fpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
    )


def ranking_scores(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), times: str | None = None) -> DataFrame:
    """roc_auc (ties averaged) and average precision; null when one class is absent."""
    c = score_curve(df, y, p, keys, times)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    ap = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    both = (F.max("p_total") > 0) & (F.max("n_total") > 0)
    return c.groupBy(*keys).agg(
        F.when(both, area / (F.max("p_total").cast("double") * F.max("n_total"))).alias("roc_auc"),
        F.when(both, ap / F.max("p_total")).alias("pr_auc"),
        (F.max("p_total") + F.max("n_total")).alias("n"),
        F.max("p_total").alias("n_positive"),
    )


def probability_scores(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), eps: float = 2.220446049250313e-16) -> DataFrame:
    """Brier score and log loss (probabilities clipped)."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1.0 - eps))
    hit = F.col(y) == 1
    return df.groupBy(*keys).agg(
        F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier_score"),
        F.avg(F.when(hit, -F.log(q)).otherwise(-F.log(1 - q))).alias("log_loss"),
    )


def _edge_bin(p: Column, bins: int, right_closed: bool) -> Column:
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    over = [(p > F.lit(e)) if right_closed else (p >= F.lit(e)) for e in edges]
    return reduce(lambda a, b: a + b, [o.cast("int") for o in over], F.lit(0))


def calibration_curve(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Mean outcome and mean score per uniform bin, right-closed edges."""
    return df.groupBy(*keys, _edge_bin(F.col(p), bins, True).alias("bin")).agg(
        F.avg(F.col(y)).alias("prob_true"), F.avg(p).alias("prob_pred"), F.count(F.lit(1)).alias("n")
    )


def expected_calibration_error(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Left-closed bins; a score of exactly 1 belongs to no bin but counts in n."""
    keys = list(keys)
    b = F.when(F.col(p) < 1, _edge_bin(F.col(p), bins, False))
    per = df.groupBy(*keys, b.alias("bin")).agg(F.avg(y).alias("a"), F.avg(p).alias("c"), F.count(F.lit(1)).alias("n"))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("a") - F.col("c")) * F.col("n")).otherwise(0.0)
    return per.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def score_histogram(df: DataFrame, y: str, p: str, bins: int = 20) -> DataFrame:
    """Counts per class in equal bins between the smallest and largest score of the class."""
    span = df.groupBy(y).agg(F.min(p).alias("lo"), F.max(p).alias("hi"))
    j = df.select(y, p).join(small_side(span), y)
    width = F.col("hi") - F.col("lo")
    pos = F.when(width > 0, F.floor((F.col(p) - F.col("lo")) / width * bins)).otherwise(F.lit(0))
    return j.groupBy(y, F.least(pos, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def evaluate(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """All binary metrics of scored rows, one row per key."""
    keys = list(keys)
    pred = df.withColumn("__pred", (F.col(p) >= threshold).cast("int"))
    parts = [
        summary_scores(pred, y, "__pred", keys).select(*keys, "accuracy", "precision_weighted", "recall_weighted", "f1_weighted"),
        ranking_scores(df, y, p, keys),
        probability_scores(df, y, p, keys),
    ]
    if not keys:  # one row each: lay the values side by side
        cells = [
            part.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in part.columns])).alias("c"))
            for part in parts
        ]
        names = [c for part in parts for c in part.columns]
        stacked = reduce(lambda a, b: a.unionByName(b), cells)
        return stacked.agg(*[F.max(F.when(F.col("c.k") == c, F.col("c.v"))).alias(c) for c in names])
    return reduce(lambda a, b: a.join(b, keys), parts)


def threshold_gate(metrics: DataFrame, metric: str = "roc_auc", at_least: float = 0.7) -> DataFrame:
    return metrics.withColumn("meets_threshold", F.coalesce(F.col(metric) >= at_least, F.lit(False)))
