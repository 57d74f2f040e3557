"""Result and log tables (R), over the three scored models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cohortry.operators import explain as X
from cohortry.operators import fairness, metrics as M, reports as R
from cohortry.plans import explanation as E
from cohortry.plans.catalog import query, table
from cohortry.plans.evaluation import CURVE_SQL
from cohortry.plans.scorecard import CARDS, long_scored, scored
from cohortry.session import scratch_dir

# metrics per model; rounded to 9 digits so that texts do not depend on summation order
MET_SQL = f"""{CURVE_SQL}, k AS (SELECT model, sum(neg * (tp - pos / 2)) / max(np) / max(nn) AS roc_auc, sum(pos * tp / (tp + fp)) / max(np) AS pr_auc FROM c GROUP BY 1),
 b AS (SELECT model, avg((p - y) * (p - y)) AS brier_score, avg(((p >= 0.5)::int = y)::int) AS accuracy FROM long GROUP BY 1),
 met AS (SELECT k.model, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc, round(brier_score, 9) AS brier_score, round(accuracy, 9) AS accuracy FROM k JOIN b ON b.model = k.model)"""


def metric_table(spark, d):
    e = M.evaluate(long_scored(spark, d), "y", "p", ["model"])
    return e.select("model", *[F.round(c, 9).alias(c) for c in ("roc_auc", "pr_auc", "brier_score", "accuracy")])


@query("e00_all_metrics", f"WITH {MET_SQL} SELECT model, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(brier_score, 6) AS brier_score, round(accuracy, 6) AS accuracy FROM met")
def e00(spark, d):
    return metric_table(spark, d)


@query(
    "r01_best_model",
    f"WITH {MET_SQL} SELECT model, round(roc_auc + pr_auc - brier_score, 6) AS composite_score, round(roc_auc, 6) AS roc_auc FROM met ORDER BY roc_auc + pr_auc - brier_score DESC, model LIMIT 1",
)
def r01(spark, d):
    return R.best_model(metric_table(spark, d)).select("model", "composite_score", "roc_auc")


def fairness_table(spark, d):
    parts = []
    s = scored(spark, d).withColumn("era", F.when(F.col("x3") > 3, "late").otherwise("early"))
    for c in CARDS:
        g = fairness.disparities(fairness.group_scores(s, ["era"], "y", f"p_{c}"))
        parts.append(g.select(F.lit(c).alias("model"), "feature", (F.col("roc_auc_disparity") * 100).alias("roc_auc_disparity")))
    return reduce(lambda a, b: a.unionByName(b), parts)


FAIR_SQL = f"""fg AS (SELECT model, CASE WHEN x3 > 3 THEN 'late' ELSE 'early' END AS grp, m.p, sum(m.y) AS pos, count(*) - sum(m.y) AS neg FROM long m JOIN base ON base.id = m.id GROUP BY 1, 2, 3),
 fc AS (SELECT *, sum(pos) OVER (PARTITION BY model, grp ORDER BY p DESC) AS tp FROM fg),
 fa AS (SELECT model, grp, sum(neg * (tp - pos / 2)) / sum(pos) / sum(neg) AS auc FROM fc GROUP BY 1, 2),
 fd AS (SELECT model, 'era' AS feature, (max(auc) - min(auc)) * 100 AS disparity FROM fa GROUP BY 1)"""


@query(
    "r02_recommendation_rows",
    f"""WITH {MET_SQL}, {FAIR_SQL} SELECT * FROM (SELECT 'deploy' AS kind, model, 'Deploy ' || model || ' as primary model (ROC-AUC: ' || printf('%.3f', roc_auc) || ')' AS recommendation FROM met ORDER BY roc_auc + pr_auc - brier_score DESC, model LIMIT 1)
 UNION ALL SELECT 'review', model, 'Review ' || model || ' for fairness issues in ' || feature || ' (disparity: ' || printf('%.3f', disparity) || ')' FROM fd WHERE disparity > 0.1
 UNION ALL SELECT 'calibrate', model, 'Consider calibrating ' || model || ' (Brier score: ' || printf('%.3f', brier_score) || ')' FROM met WHERE brier_score > 0.25""",
)
def r02(spark, d):
    """Disparities are stretched a hundredfold, as these models are nearly fair."""
    return R.recommendation_lines(metric_table(spark, d), fairness_table(spark, d))


@query(
    "r03_production_readiness",
    f"""WITH {MET_SQL}, f AS (SELECT *, roc_auc >= 0.75 AND accuracy >= 0.7 AND brier_score <= 0.25 AS ready FROM met)
 SELECT model, ready AS meets_performance_criteria, true AS meets_stability_criteria, ready AS production_ready,
 concat_ws(' | ', CASE WHEN NOT ready AND roc_auc < 0.75 THEN 'Improve ROC-AUC from ' || printf('%.3f', roc_auc) || ' to >0.75' END,
 CASE WHEN NOT ready AND brier_score > 0.25 THEN 'Improve calibration (Brier score: ' || printf('%.3f', brier_score) || ')' END, CASE WHEN ready THEN '✅ Ready for production deployment' END) AS advice FROM f""",
)
def r03(spark, d):
    r = R.production_readiness(metric_table(spark, d))
    return r.select(
        "model", "meets_performance_criteria", "meets_stability_criteria", "production_ready", F.array_join("recommendations", " | ").alias("advice")
    )


@query(
    "r04_training_summary",
    f"WITH {MET_SQL} SELECT count(*) AS n_models, count(*) FILTER (WHERE roc_auc >= 0.5) AS n_meeting_threshold, (SELECT model FROM met ORDER BY roc_auc DESC, model LIMIT 1) AS best_model, round(max(roc_auc), 6) AS best_roc_auc FROM met",
)
def r04(spark, d):
    return R.training_summary(metric_table(spark, d), 0.5)


# one accuracy per (priority, model): priorities stand for datasets
RES_SQL = "res AS (SELECT o_orderpriority AS dataset, model, round(avg(((p >= 0.5)::int = y)::int), 9) AS accuracy FROM long GROUP BY 1, 2)"


@query(
    "r05_cross_dataset_summary",
    f"""WITH {CURVE_SQL}, {RES_SQL} SELECT 'total' AS section, 'runs' AS name, count(*)::double AS value FROM res UNION ALL SELECT 'total', 'datasets', count(DISTINCT dataset)::double FROM res
 UNION ALL SELECT 'total', 'models', count(DISTINCT model)::double FROM res
 UNION ALL SELECT 'top', name, v FROM (SELECT dataset || '/' || model AS name, round(accuracy, 6) AS v FROM res ORDER BY accuracy DESC, dataset, model LIMIT 10)
 UNION ALL SELECT 'by_model', model, round(avg(accuracy), 6) FROM res GROUP BY model UNION ALL SELECT 'by_dataset', dataset, round(avg(accuracy), 6) FROM res GROUP BY dataset""",
)
def r05(spark, d):
    hit = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")
    res = long_scored(spark, d).groupBy(F.col("o_orderpriority").alias("dataset"), "model").agg(F.round(F.avg(hit), 9).alias("accuracy"))
    return R.cross_dataset_summary(res)


@query(
    "r06_run_log",
    f"""SELECT 'run_' || o_orderstatus AS run_id, 'metric' AS kind, 'class_' || replace(o_orderpriority, ':', '_') || '.count' AS key, count(*)::varchar AS value FROM orders GROUP BY o_orderstatus, o_orderpriority
 UNION ALL SELECT 'run_' || o_orderstatus, 'param', 'n_orders', count(*)::varchar FROM orders GROUP BY o_orderstatus""",
)
def r06(spark, d):
    """Two appends to the log, read back; keys are sanitized."""
    o = table(spark, d, "orders")
    run, ts = F.concat(F.lit("run_"), F.col("o_orderstatus")), F.current_timestamp()
    per = o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("value"))
    per = per.withColumn("key", F.concat("o_orderpriority", F.lit(".count")))
    total = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("value")).withColumn("key", F.lit("n_orders"))
    path = scratch_dir(spark)
    R.append_log(R.log_rows(per, run, ts, "metric", "class:"), path)
    R.append_log(R.log_rows(total, run, ts, "param"), path)
    return spark.read.parquet(path).select("run_id", "kind", "key", "value")


@query(
    "r07_latest_runs",
    "SELECT o_custkey, o_orderkey, position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS position FROM orders) WHERE position <= 3",
)
def r07(spark, d):
    """Orders of a customer stand for runs of a name: keep the newest three."""
    return R.latest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey", "position")


@query(
    "r08_explanation_report",
    f"WITH {E.RISK_SQL} SELECT 'top_features' AS section, feature AS name, printf('%.4f', importance) AS detail FROM (SELECT * FROM ni ORDER BY importance DESC, feature LIMIT 5) UNION ALL SELECT 'clinical_analysis', aspect, finding FROM rf",
)
def r08(spark, d):
    imp = E.named_importance(spark, d)
    return R.explanation_report(imp, X.risk_factors(imp, E.groups(spark)))


@query("r09_registration_summary", "SELECT CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'skipped' END AS status, count(*) AS n FROM orders GROUP BY 1")
def r09(spark, d):
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "success").when(s == "O", "failed").otherwise("skipped")
    return R.registration_summary(table(spark, d, "orders").select(status.alias("status")))
