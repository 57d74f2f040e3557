"""Similar patients, cohorts and recommendations (N), pair join (J5), profiles (A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.operators import cohorts as C
from cohortry.operators import recommend as R
from cohortry.operators import similarity as S
from cohortry.operators.knn import cosine, nearest
from cohortry.plans.catalog import query, table
from cohortry.plans.scorecard import SCORED_SQL, scored
from cohortry.session import checkpoint, scratch_dir

FEATS = ["f1", "f2", "f3", "f4"]
PF_SQL = """pf AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS f1, coalesce(n, 0)::double AS f2, price AS f3, urgent::double AS f4,
 coalesce(n_f * 2 > n, false)::int AS target, 100 + coalesce(n, 0) * 4 AS trestbps, 180 + c_nationkey * 4 AS chol, 160 - coalesce(urgent, 0) * 15 AS thalach, c_nationkey % 4 AS cp
 FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS price, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
 count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""
FILL_SQL = ", ".join(f"coalesce({f}, (SELECT quantile_cont({f}, 0.5) FROM pf)) AS {f}" for f in FEATS)
EMB_SQL = f"""{PF_SQL}, fl AS (SELECT id, {FILL_SQL} FROM pf), em AS (SELECT id, {", ".join(f"({f} - (SELECT avg({f}) FROM fl)) / (SELECT stddev_pop({f}) FROM fl) AS {f}" for f in FEATS)} FROM fl)"""


def features(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("price"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"),
    )
    c = table(spark, d, "customer")
    n = F.coalesce(F.col("n"), F.lit(0))
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("f1"), n.cast("double").alias("f2"),
        F.col("price").alias("f3"), F.col("urgent").cast("double").alias("f4"),
        F.coalesce(F.col("n_f") * 2 > F.col("n"), F.lit(False)).cast("int").alias("target"),
        (100 + n * 4).alias("trestbps"), (180 + F.col("c_nationkey") * 4).alias("chol"),
        (160 - F.coalesce(F.col("urgent"), F.lit(0)) * 15).alias("thalach"), (F.col("c_nationkey") % 4).alias("cp"),
    )


def embedding(spark, d):
    return S.embed(features(spark, d), "id", FEATS)


@query("n01_patient_embedding", f"WITH {EMB_SQL} SELECT id, {', '.join(f'round({f}, 6) AS {f}' for f in FEATS)} FROM em")
def n01(spark, d):
    return embedding(spark, d).select("id", *[F.element_at("vec", i + 1).alias(f) for i, f in enumerate(FEATS)])


@query("n02_pca")
def n02(spark, d):
    p = S.pca(embedding(spark, d), "id", k=2)
    return p.select("id", F.abs(F.element_at("components", 1)).alias("c1"), F.abs(F.element_at("components", 2)).alias("c2"))


def _sum(parts):
    return "(" + " + ".join(parts) + ")"


SQ = _sum([f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in FEATS])
MAN = _sum([f"abs(a.{f} - b.{f})" for f in FEATS])
COS = f"({_sum([f'a.{f} * b.{f}' for f in FEATS])} / (sqrt({_sum([f'a.{f} * a.{f}' for f in FEATS])}) * sqrt({_sum([f'b.{f} * b.{f}' for f in FEATS])})))"
SIM = f"round(least(greatest(0.4e0 * (1 - sqrt({SQ}) / 2) + 0.3e0 * {COS} + 0.3e0 * (1 - {MAN} / 4), 0), 1), 12)"
SIM_SQL = f"""{EMB_SQL}, sim AS (SELECT a.id AS patient, b.id AS neighbour, {SIM} AS similarity FROM em a JOIN em b ON a.id <> b.id),
 nb AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY similarity DESC, neighbour) AS rank FROM sim WHERE similarity >= 0.3)"""


def similar(spark, d, k=10):
    return S.similar_patients(embedding(spark, d), "id", k)


@query("n03_weighted_similarity", f"WITH {SIM_SQL} SELECT patient, count(*) AS n_compared, round(max(similarity), 6) AS best_similarity FROM nb WHERE rank <= 10 GROUP BY patient")
def n03(spark, d):
    """Weighted similarity of every patient to its closest others."""
    return similar(spark, d).groupBy("patient").agg(F.count(F.lit(1)).alias("n_compared"), F.max("similarity").alias("best_similarity"))


@query("n04_similar_patients", f"WITH {SIM_SQL} SELECT patient, neighbour, round(similarity, 6) AS similarity, rank FROM nb WHERE rank <= 10")
def n04(spark, d):
    return similar(spark, d)


@query(
    "n05_nearest_background",
    f"""WITH {EMB_SQL}, bg AS (SELECT * FROM em ORDER BY ('0x' || substr(md5(concat_ws('|', id, '42')), 1, 8))::bigint, id LIMIT 256),
 p AS (SELECT a.id, b.id AS bg_id, round(sqrt({SQ}), 12) AS distance FROM em a, bg b)
 SELECT id, bg_id, round(distance, 6) AS distance, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, bg_id) AS r FROM p) WHERE r <= 2""",
)
def n05(spark, d):
    from cohortry.operators.splits import sample_rows

    e = embedding(spark, d)
    bg = sample_rows(e, ["id"], 256).select(F.col("id").alias("bg_id"), "vec")
    return S.nearest_background(e, bg, "id", "bg_id", 2)


@query(
    "j05_pair_join_topk",
    """WITH e AS (SELECT vec_id, embedding::double[] AS v FROM embeddings), p AS (SELECT a.vec_id AS q, b.vec_id AS c, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id)
 SELECT q, c, round(s, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 12) DESC, c) AS r FROM p) WHERE r <= 5""",
)
def j05(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    near = nearest(e.select(F.col("vec_id").alias("qid"), "vec"), e.select(F.col("vec_id").alias("cid"), "vec"), 5, cosine())
    return near.select(F.col("qid").alias("q"), F.col("cid").alias("c"), "score", "rank")


@query("n06_kmeans_cohorts")
def n06(spark, d):
    return C.kmeans_cohorts(embedding(spark, d), "id", 5, n_init=3).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


@query("n07_dbscan_cohorts")
def n07(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    return C.dbscan(S.embed(e, "id", ["m", "n"]), "id", 0.5, 5)


A10_SQL = "pr AS (SELECT c_custkey AS id, c_nationkey % 4 - 1 AS cohort, c_acctbal AS balance, c_nationkey AS nation, c_mktsegment AS segment FROM customer WHERE c_custkey >= 0)"


@query(
    "a10_cohort_profile",
    f"""WITH {A10_SQL}, x AS (SELECT * FROM pr WHERE cohort <> -1), m AS (SELECT cohort, segment, row_number() OVER (PARTITION BY cohort ORDER BY count(*) DESC, segment) AS r FROM x GROUP BY 1, 2)
 SELECT cohort, 'size' AS characteristic, count(*)::double AS number, NULL::varchar AS mode FROM x GROUP BY 1
 UNION ALL SELECT cohort, 'balance_mean', round(avg(balance), 6), NULL FROM x GROUP BY 1 UNION ALL SELECT cohort, 'balance_std', round(stddev_samp(balance), 6), NULL FROM x GROUP BY 1
 UNION ALL SELECT cohort, 'nation_mean', round(avg(nation), 6), NULL FROM x GROUP BY 1 UNION ALL SELECT cohort, 'nation_std', round(stddev_samp(nation), 6), NULL FROM x GROUP BY 1
 UNION ALL SELECT cohort, 'segment_mode', NULL, segment FROM m WHERE r = 1""",
)
def a10(spark, d):
    c = table(spark, d, "customer")
    pr = c.select(
        F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 4 - 1).alias("cohort"), F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
    )
    return C.cohort_profiles(pr, "cohort", "id")


STAT_SQL = f"""{SIM_SQL}, st AS (SELECT pf.id AS patient, count(nb.neighbour) AS n, count(*) FILTER (WHERE o.target = 1) AS high, avg(similarity) AS ms
 FROM pf LEFT JOIN nb ON nb.patient = pf.id AND rank <= 10 LEFT JOIN pf o ON o.id = nb.neighbour GROUP BY 1)"""


def recs(spark, d):
    f = features(spark, d)
    outcomes = f.select(F.col("id").alias("neighbour"), "target")
    stats = R.neighbour_stats(S.similar_patients(S.embed(f, "id", FEATS), "id", 10), outcomes)
    return R.recommendations(f.withColumnRenamed("id", "patient"), stats)


@query(
    "n09_treatment_rules",
    f"""WITH {STAT_SQL}, r AS (SELECT st.*, pf.trestbps, pf.chol, pf.thalach, pf.cp FROM st JOIN pf ON pf.id = st.patient WHERE n > 0),
 i AS (SELECT patient, 1 AS o, 'ACE inhibitor therapy' AS treatment, 0.85e0 AS confidence, 'Hypertension detected (BP: ' || trestbps || ')' AS reasoning FROM r WHERE trestbps > 140
 UNION ALL SELECT patient, 2, 'Statin therapy', 0.8e0, 'High cholesterol level (' || chol || ' mg/dL)' FROM r WHERE chol > 240
 UNION ALL SELECT patient, 3, 'Cardiac rehabilitation', 0.75e0, 'Low max heart rate (' || thalach || ') suggests reduced capacity' FROM r WHERE thalach < 120
 UNION ALL SELECT patient, 4, 'Coronary angiography', 0.8e0, 'Chest pain type ' || cp || ' suggests cardiac evaluation needed' FROM r WHERE cp IN (1, 2)
 UNION ALL SELECT patient, 5, 'Oncology referral', least(0.9e0, round(0.7e0 + n / 10, 6)), high || '/' || n || ' similar patients are high-risk' FROM r WHERE high > n * 0.6e0
 UNION ALL SELECT patient, 6, 'Genetic counseling', 0.7e0, 'High-risk profile similar to other patients' FROM r WHERE high > n * 0.6e0
 UNION ALL SELECT patient, 7, 'Regular monitoring', 0.75e0, 'Lower risk profile based on ' || n || ' similar patients' FROM r WHERE NOT high > n * 0.6e0
 UNION ALL SELECT patient, 8, 'Patient education and support', 0.8e0, 'Evidence-based patient care standard' FROM r)
 SELECT patient, (row_number() OVER (PARTITION BY patient ORDER BY o) - 1)::int AS position, treatment, confidence, reasoning FROM i""",
)
def n09(spark, d):
    return R.recommendation_rows(recs(spark, d))


@query(
    "n10_overall_confidence",
    f"WITH {STAT_SQL} SELECT patient, n AS n_similar, CASE WHEN n >= 5 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM st",
)
def n10(spark, d):
    return recs(spark, d).select("patient", "n_similar", "confidence")


@query(
    "n11_personalization_score",
    f"WITH {STAT_SQL} SELECT patient, CASE WHEN n > 0 THEN round(round(0.7e0 * ms + 0.3e0 * least(1, n / 10), 9), 3) ELSE 0e0 END AS personalization_score FROM st",
)
def n11(spark, d):
    return recs(spark, d).select("patient", "personalization_score")


@query(
    "n12_patient_report",
    f"""WITH {STAT_SQL}, top AS (SELECT patient, string_agg(neighbour::varchar, ',' ORDER BY rank) AS neighbours FROM nb WHERE rank <= 5 GROUP BY 1)
 SELECT st.patient, pf.segment, (pf.cp - 1)::int AS cohort, coalesce(top.neighbours, '') AS neighbours,
 CASE WHEN n > 0 THEN (trestbps > 140)::int + (chol > 240)::int + (thalach < 120)::int + (cp IN (1, 2))::int + CASE WHEN high > n * 0.6e0 THEN 2 ELSE 1 END + 1 ELSE 0 END AS n_recommendations
 FROM st JOIN pf ON pf.id = st.patient LEFT JOIN top ON top.patient = st.patient""",
)
def n12(spark, d):
    f = features(spark, d)
    near = checkpoint(S.similar_patients(S.embed(f, "id", FEATS), "id", 10))  # read by two branches
    r = R.recommendations(f.withColumnRenamed("id", "patient"), R.neighbour_stats(near, f.select(F.col("id").alias("neighbour"), "target")))
    cohorts = f.select(F.col("id").alias("patient"), (F.col("cp") - 1).cast("int").alias("cohort"))
    rep = R.patient_reports(f.select(F.col("id").alias("patient"), "segment", "f1"), cohorts, near, r)
    ids = F.array_join(F.transform("similar_patients", lambda s: s["neighbour"].cast("string")), ",")
    return rep.select(
        "patient", "patient_profile.segment", "cohort", F.coalesce(ids, F.lit("")).alias("neighbours"),
        F.size("recommendations").alias("n_recommendations"),
    )


@query(
    "n13_risk_cohort",
    f"""WITH {SCORED_SQL} SELECT id, CASE WHEN p_a >= 0.75 THEN 'high' WHEN p_a >= 0.5 THEN 'medium' ELSE 'low' END AS risk,
 CASE WHEN 1 - p_a >= 0.75 THEN 'high' WHEN 1 - p_a >= 0.5 THEN 'medium' ELSE 'low' END AS inverted FROM scored""",
)
def n13(spark, d):
    p = F.col("p_a")
    return scored(spark, d).select("id", R.risk_cohort(p).alias("risk"), R.risk_cohort(p, True).alias("inverted"))


@query("n15_persisted_embedding", f"WITH {EMB_SQL} SELECT id, {', '.join(f'round({f}, 6) AS {f}' for f in FEATS)} FROM em")
def n15(spark, d):
    path = scratch_dir(spark)
    embedding(spark, d).write.parquet(path)
    return spark.read.parquet(path).select("id", *[F.element_at("vec", i + 1).alias(f) for i, f in enumerate(FEATS)])
