"""Evaluation (E), fairness (F) and curve queries on the scored orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.operators import fairness, metrics as M
from cohortry.plans.catalog import query
from cohortry.plans.scorecard import LONG_SQL, SCORED_SQL, long_scored, scored

# three-class prediction of the order status from two scorecards
PRED_SQL = "CASE WHEN p_a >= 0.55 THEN 'F' WHEN p_b >= 0.5 THEN 'O' ELSE 'P' END"
REPORT_SQL = f"""{SCORED_SQL}, m AS (SELECT o_orderstatus AS t, {PRED_SQL} AS q FROM scored),
 l AS (SELECT t AS label FROM m UNION SELECT q FROM m),
 r AS (SELECT label, (SELECT count(*) FROM m WHERE t = label) AS support, (SELECT count(*) FROM m WHERE q = label) AS predicted,
 (SELECT count(*) FROM m WHERE t = label AND q = label) AS tp FROM l),
 s AS (SELECT label, support, tp, CASE WHEN predicted = 0 THEN 0e0 ELSE tp / predicted END AS p, CASE WHEN support = 0 THEN 0e0 ELSE tp / support END AS r FROM r),
 rep AS (SELECT *, CASE WHEN p + r = 0 THEN 0e0 ELSE 2 * p * r / (p + r) END AS f1 FROM s)"""


def predicted(spark, d):
    s = scored(spark, d)
    pred = F.when(F.col("p_a") >= 0.55, "F").when(F.col("p_b") >= 0.5, "O").otherwise("P")
    return s.select("id", F.col("o_orderstatus").alias("truth"), pred.alias("pred"))


@query(
    "e01_weighted_scores",
    f"""WITH {REPORT_SQL} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS precision_weighted,
 round(sum(r * support) / sum(support), 6) AS recall_weighted, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM rep""",
)
def e01(spark, d):
    s = M.summary_scores(predicted(spark, d), "truth", "pred")
    return s.select("accuracy", "precision_weighted", "recall_weighted", "f1_weighted")


@query(
    "e02_class_report",
    f"""WITH {REPORT_SQL} SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support::bigint AS support FROM rep
 UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), sum(support)::bigint FROM rep
 UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::bigint FROM rep""",
)
def e02(spark, d):
    df = predicted(spark, d)
    rep = M.class_report(df, "truth", "pred").select("label", "precision", "recall", "f1", "support")
    s = M.summary_scores(df, "truth", "pred")
    lines = F.array(
        *[
            F.struct(
                F.lit(f"{kind} avg").alias("label"),
                *[F.col(f"{m}_{kind}").alias(m) for m in ("precision", "recall", "f1")],
                F.col("n").alias("support"),
            )
            for kind in ("macro", "weighted")
        ]
    )
    return rep.unionByName(s.select(F.inline(lines)))


@query(
    "e03_confusion_matrix",
    f"""WITH {SCORED_SQL}, c AS (SELECT o_orderstatus AS truth, {PRED_SQL} AS pred, count(*) AS n FROM scored GROUP BY 1, 2)
 SELECT truth, pred, n, round(n / sum(n) OVER (PARTITION BY truth), 6) AS share FROM c""",
)
def e03(spark, d):
    return M.confusion(predicted(spark, d), "truth", "pred")


@query(
    "e03_sensitivity_specificity",
    f"""WITH {LONG_SQL}, c AS (SELECT model, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn,
 count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn FROM long GROUP BY 1)
 SELECT *, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS sensitivity, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity FROM c""",
)
def e03b(spark, d):
    df = long_scored(spark, d).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    return M.binary_rates(df, "y", "pred", ["model"])


# cumulative counts over distinct scores, highest first
CURVE_SQL = f"""{LONG_SQL}, g AS (SELECT model, p, sum(y) AS pos, count(*) AS n FROM long GROUP BY 1, 2),
 c AS (SELECT model, p, pos, n - pos AS neg, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS np, sum(n - pos) OVER (PARTITION BY model) AS nn
 FROM g WINDOW w AS (PARTITION BY model ORDER BY p DESC))"""


@query("e04_roc_auc", f"WITH {CURVE_SQL} SELECT model, round(sum(neg * (tp - pos / 2)) / max(np) / max(nn), 6) AS roc_auc FROM c GROUP BY model")
def e04(spark, d):
    return M.ranking_scores(long_scored(spark, d), "y", "p", ["model"]).select("model", "roc_auc")


@query("e05_average_precision", f"WITH {CURVE_SQL} SELECT model, round(sum(pos * tp / (tp + fp)) / max(np), 6) AS pr_auc FROM c GROUP BY model")
def e05(spark, d):
    return M.ranking_scores(long_scored(spark, d), "y", "p", ["model"]).select("model", "pr_auc")


@query(
    "e06_brier_log_loss",
    f"WITH {LONG_SQL} SELECT model, round(avg((p - y) * (p - y)), 6) AS brier_score, round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss FROM long GROUP BY model",
)
def e06(spark, d):
    return M.probability_scores(long_scored(spark, d), "y", "p", ["model"])


@query(
    "e07_curve_points",
    f"""WITH {CURVE_SQL} SELECT model, p AS threshold, tp::bigint AS tp, fp::bigint AS fp, round(tp / np, 6) AS tpr, round(fp / nn, 6) AS fpr,
 round(tp / (tp + fp), 6) AS precision FROM c""",
)
def e07(spark, d):
    return M.curve_points(long_scored(spark, d), "y", "p", ["model"])


@query(
    "w06_cumulative_curve",
    f"WITH {CURVE_SQL} SELECT p AS score, pos::bigint AS pos, neg::bigint AS neg, tp::bigint AS tp, fp::bigint AS fp FROM c WHERE model = 'a'",
)
def w06(spark, d):
    c = M.score_curve(scored(spark, d), "y", "p_a")
    return c.select("score", "pos", "neg", "tp", "fp")


EDGES = [i * 0.1 for i in range(1, 10)]
RIGHT_BIN = " + ".join(f"(p > {e!r}::double)::int" for e in EDGES)
LEFT_BIN = " + ".join(f"(p >= {e!r}::double)::int" for e in EDGES)


@query(
    "e08_calibration_curve",
    f"WITH {LONG_SQL} SELECT model, {RIGHT_BIN} AS bin, round(avg(y), 6) AS prob_true, round(avg(p), 6) AS prob_pred, count(*) AS n FROM long GROUP BY 1, 2",
)
def e08(spark, d):
    return M.calibration_curve(long_scored(spark, d), "y", "p", ["model"])


@query(
    "e09_calibration_error",
    f"""WITH {LONG_SQL}, b AS (SELECT model, CASE WHEN p < 1 THEN {LEFT_BIN} END AS bin, avg(y) AS a, avg(p) AS c, count(*) AS n FROM long GROUP BY 1, 2)
 SELECT model, round(sum(CASE WHEN bin IS NULL THEN 0 ELSE abs(a - c) * n END) / sum(n), 6) AS ece FROM b GROUP BY model""",
)
def e09(spark, d):
    return M.expected_calibration_error(long_scored(spark, d), "y", "p", ["model"])


@query(
    "e10_score_histogram",
    f"""WITH {SCORED_SQL}, r AS (SELECT y, min(p_a) AS lo, max(p_a) AS hi FROM scored GROUP BY 1)
 SELECT s.y, least(CASE WHEN hi > lo THEN floor((p_a - lo) / (hi - lo) * 20) ELSE 0 END, 19)::int AS bin, count(*) AS n FROM scored s JOIN r ON r.y = s.y GROUP BY 1, 2""",
)
def e10(spark, d):
    return M.score_histogram(scored(spark, d), "y", "p_a")


@query(
    "e11_threshold_gate",
    f"""WITH {CURVE_SQL}, a AS (SELECT model, sum(neg * (tp - pos / 2)) / max(np) / max(nn) AS auc FROM c GROUP BY model)
 SELECT model, round(auc, 6) AS roc_auc, auc >= 0.5 AS meets_threshold FROM a""",
)
def e11(spark, d):
    return M.threshold_gate(e04(spark, d), at_least=0.5)


GROUP_SQL = f"""{SCORED_SQL}, med AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM scored),
 k AS (SELECT 'o_totalprice' AS feature, CASE WHEN o_totalprice > (SELECT m FROM med) THEN '1' ELSE '0' END AS grp, y, p_a AS p FROM scored
 UNION ALL SELECT 'o_orderpriority', o_orderpriority, y, p_a FROM scored),
 g AS (SELECT feature, grp, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM k GROUP BY 1, 2, 3),
 c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (PARTITION BY feature, grp ORDER BY p DESC)),
 s AS (SELECT feature, grp, (sum(pos) + sum(neg))::bigint AS size, sum(pos) / (sum(pos) + sum(neg)) AS positive_rate,
 sum(neg * (tp - pos / 2)) / sum(pos) / sum(neg) AS roc_auc, sum(pos * tp / (tp + fp)) / sum(pos) AS pr_auc FROM c GROUP BY 1, 2 HAVING sum(pos) > 0 AND sum(neg) > 0)"""


@query(
    "f01_group_fairness",
    f"WITH {GROUP_SQL} SELECT feature, grp, size, round(positive_rate, 6) AS positive_rate, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM s",
)
def f01(spark, d):
    return fairness.group_scores(scored(spark, d), ["o_totalprice", "o_orderpriority"], "y", "p_a")


@query(
    "f02_disparities",
    f"""WITH {GROUP_SQL} SELECT feature, count(*) AS n_groups, round(max(roc_auc) - min(roc_auc), 6) AS roc_auc_disparity,
 round(max(positive_rate) - min(positive_rate), 6) AS positive_rate_disparity, round(max(roc_auc) - min(roc_auc), 6) AS equalized_odds
 FROM s GROUP BY feature HAVING count(*) >= 2""",
)
def f02(spark, d):
    return fairness.disparities(f01(spark, d))
