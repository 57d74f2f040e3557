"""Rule-based recommendations, confidence and patient reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column, condition, treatment, confidence, reasoning (printf format and
# the argument as text).
TREATMENT_RULES = [
    ("area_worst", "area_worst > 1000", "Neoadjuvant chemotherapy", 0.85, "Large tumor area (%.1f) suggests aggressive treatment"),
    ("concave_points_worst", "concave_points_worst > 0.15", "Surgical consultation for wide excision", 0.80, "High concave points (%.3f) indicate irregular borders"),
    ("radius_worst", "radius_worst > 20", "Mastectomy evaluation", 0.75, "Large tumor radius (%.1f) may require extensive surgery"),
    ("trestbps", "trestbps > 140", "ACE inhibitor therapy", 0.85, "Hypertension detected (BP: %s)"),
    ("chol", "chol > 240", "Statin therapy", 0.80, "High cholesterol level (%s mg/dL)"),
    ("thalach", "thalach < 120", "Cardiac rehabilitation", 0.75, "Low max heart rate (%s) suggests reduced capacity"),
    ("cp", "cp in (1, 2)", "Coronary angiography", 0.80, "Chest pain type %s suggests cardiac evaluation needed"),
]
HIGH_RISK_SHARE = 0.6


def _item(treatment: Column | str, confidence: Column | float, reasoning: Column | str) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        lit(treatment).alias("treatment"), lit(confidence).cast("double").alias("confidence"), lit(reasoning).alias("reasoning")
    )


def neighbour_stats(similar: DataFrame, outcomes: DataFrame) -> DataFrame:
    """similar: patient, neighbour, similarity; outcomes: neighbour, target."""
    return similar.join(outcomes, "neighbour", "left").groupBy("patient").agg(
        F.count(F.lit(1)).alias("n_similar"),
        F.count_if(F.col("target") == 1).alias("n_high_risk"),
        F.avg("similarity").alias("mean_similarity"),
    )


def overall_confidence(n: Column) -> Column:
    return F.when(n >= 5, "high").when(n >= 3, "medium").otherwise("low")


def personalization_score(mean_similarity: Column, n: Column) -> Column:
    score = 0.7 * mean_similarity + 0.3 * F.least(F.lit(1.0), n / 10)
    return F.when(n > 0, F.round(score, 3)).otherwise(F.lit(0.0))


def treatment_items(df: DataFrame) -> Column:
    """Array of recommendations of a row with patient columns, n_similar, n_high_risk."""
    n, high = F.col("n_similar"), F.col("n_high_risk")
    items = []
    for col, cond, treatment, conf, text in TREATMENT_RULES:
        if col in df.columns:
            reason = F.format_string(text, F.col(col).cast("string") if "%s" in text else F.col(col).cast("double"))
            items.append(F.when(F.expr(cond), _item(treatment, conf, reason)))
    risky = high > n * HIGH_RISK_SHARE
    share = F.concat(high.cast("string"), F.lit("/"), n.cast("string"), F.lit(" similar patients are high-risk"))
    items.append(F.when(risky, _item("Oncology referral", F.least(F.lit(0.90), 0.70 + n / 10), share)))
    items.append(F.when(risky, _item("Genetic counseling", 0.70, "High-risk profile similar to other patients")))
    calm = F.concat(F.lit("Lower risk profile based on "), n.cast("string"), F.lit(" similar patients"))
    items.append(F.when(~risky, _item("Regular monitoring", 0.75, calm)))
    items.append(_item("Patient education and support", 0.80, "Evidence-based patient care standard"))
    return F.array_compact(F.array(*items))


def recommendations(patients: DataFrame, stats: DataFrame) -> DataFrame:
    """patients (with `patient`) plus neighbour counts, recommendation array, overall
    confidence and score. Without neighbours the list is empty and confidence low."""
    df = patients.join(stats, "patient", "left").withColumns(
        {"n_similar": F.coalesce("n_similar", F.lit(0)), "n_high_risk": F.coalesce("n_high_risk", F.lit(0))}
    )
    items = treatment_items(df)
    none = F.slice(items, 1, 0)
    return df.withColumns(
        {
            "recommendations": F.when(F.col("n_similar") > 0, items).otherwise(none),
            "confidence": overall_confidence(F.col("n_similar")),
            "personalization_score": personalization_score(F.col("mean_similarity"), F.col("n_similar")),
        }
    )


def recommendation_rows(recs: DataFrame) -> DataFrame:
    return recs.select("patient", F.posexplode("recommendations").alias("position", "r")).select(
        "patient", "position", "r.treatment", "r.confidence", "r.reasoning"
    )


def patient_reports(profile: DataFrame, cohorts: DataFrame, similar: DataFrame, recs: DataFrame, top: int = 5) -> DataFrame:
    """One nested row per patient: profile, cohort, nearest neighbours, recommendations
    and the score. `similar` is ranked, so a report holds at most `top` neighbours."""
    near = (
        similar.filter(F.col("rank") <= top).groupBy("patient")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "similarity"))).alias("similar_patients"))
    )
    body = profile.select("patient", F.struct(*[c for c in profile.columns if c != "patient"]).alias("patient_profile"))
    return (
        body.join(cohorts, "patient", "left").join(near, "patient", "left")
        .join(recs.select("patient", "recommendations", "confidence", "personalization_score"), "patient", "left")
    )


def risk_cohort(p: Column, favourable: bool = False) -> Column:
    risk = 1 - p if favourable else p
    return F.when(risk >= 0.75, "high").when(risk >= 0.5, "medium").otherwise("low")


def monitor_advice(contributions: DataFrame, top: int = 3) -> DataFrame:
    """contributions: row id, feature, contribution, value, rank by magnitude. Advice for
    the positive ones among the first."""
    pos = contributions.filter((F.col("rank") <= top) & (F.col("contribution") > 0))
    text = F.concat(F.lit("Monitor "), F.col("feature"), F.lit(" closely (current: "), F.col("value").cast("string"), F.lit(")"))
    return pos.select("row_id", "rank", text.alias("advice"))
