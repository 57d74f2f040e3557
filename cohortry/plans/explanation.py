"""Attribution queries (X), background join (J6), importance summaries (A11, A12, X1),
voting (M2, M3), scoring (M12) and advice (N14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cohortry.operators import ensemble as V
from cohortry.operators import explain as X
from cohortry.operators import treeshap as T
from cohortry.operators.models import fit_forest
from cohortry.operators.lookup import literal_table
from cohortry.operators.recommend import monitor_advice
from cohortry.operators.splits import sample_rows
from cohortry.plans import scorecard as S
from cohortry.plans.catalog import query
from cohortry.plans.scorecard import BASE_SQL, CARDS, FEATURES, SCORED_SQL

H = "('0x' || substr(md5(concat_ws('|', {c}, '{s}')), 1, 8))::bigint"


def phi_sql(card: str) -> str:
    w = CARDS[card][1]
    return " UNION ALL ".join(
        f"SELECT id AS row_id, '{f}' AS feature, {i} AS i, {f} AS value, {wi}::double * ({f} - (SELECT avg({f}) FROM base)) AS contribution FROM base"
        for i, (f, wi) in enumerate(zip(FEATURES, w))
    )


def ranked_sql(card: str = "a") -> str:
    return f"""{BASE_SQL}, phi AS ({phi_sql(card)}), ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, i) AS rank FROM phi)"""


def linear(spark, d, card="a"):
    b = S.base(spark, d)
    means = X.background_means(b, FEATURES)
    return X.contribution_rows(b, "id", FEATURES, X.linear_contributions(FEATURES, CARDS[card][1], means))


@query("x03_linear_shap", f"WITH {ranked_sql()} SELECT row_id, feature, round(value, 9) AS value, round(contribution, 9) AS contribution FROM phi", digits=9)
def x03(spark, d):
    return linear(spark, d).drop("rank")


BG_SQL = f"bg AS (SELECT x1, x2, x3, x4 FROM base ORDER BY {H.format(c='id', s='7')}, id LIMIT 10)"


def background(spark, d, n=10):
    return X.background_rows(sample_rows(S.base(spark, d), ["id"], n, 7), FEATURES)


def card_score(card):
    return lambda x: S.p(card, x, None)


def exact_sql(card: str) -> str:
    """Probability-space Shapley values over the background, all 16 coalitions."""
    v = ", ".join(
        f"avg({S.p_sql(card, [('r.' if m >> j & 1 else 'b.') + f for j, f in enumerate(FEATURES)], None)}) AS v{m}" for m in range(16)
    )
    phis = []
    for i in range(4):
        terms = []
        for m in range(16):
            if not m >> i & 1:
                terms.append(f"{X.coalition_weight(bin(m).count('1'), 4)!r}::double * (v{m | 1 << i} - v{m})")
        phis.append(f"round({' + '.join(terms)}, 6) AS phi_{FEATURES[i]}")
    return f"WITH {BASE_SQL}, {BG_SQL}, v AS (SELECT r.id, {v} FROM base r, bg b GROUP BY r.id) SELECT id, round(v0, 6) AS base_value, {', '.join(phis)} FROM v"


@query("x03_exact_shap", exact_sql("a"))
def x03b(spark, d):
    out = X.exact_shapley(S.base(spark, d), FEATURES, background(spark, d), card_score("a"))
    return out.select("id", "base_value", *[F.col("phi")[i].alias(f"phi_{f}") for i, f in enumerate(FEATURES)])


@query("x04_model_shap", exact_sql("c").replace("round(v0, 6) AS base_value, ", ""))
def x04(spark, d):
    """The same through the path for models that score DataFrames."""
    def score(df):
        x = {f: F.col("vec")[i] for i, f in enumerate(FEATURES)}
        return df.withColumn("score", S.p("c", x, None))

    out = X.model_contributions(S.base(spark, d), "id", FEATURES, background(spark, d), score)
    return out.select("id", *[F.col("phi")[i].alias(f"phi_{f}") for i, f in enumerate(FEATURES)])


@query("x04_forest_shap")
def x04_forest(spark, d):
    """Exact contributions of every order under a random forest fitted with the library's
    settings, against 100 background rows, from the trees' leaf paths; phi sums to the
    forest's probability minus the background mean. SQL cannot score a fitted forest;
    tests/test_treeshap.py holds the paths against scoring every coalition."""
    b = S.base(spark, d).withColumn("label_index", F.col("y").cast("double"))
    model = fit_forest(b, "id", FEATURES)
    out = T.tree_contributions(b, "id", FEATURES, model, background(spark, d, 100))
    return out.select("id", "value", "base_value", *[F.col("phi")[i].alias(f"phi_{f}") for i, f in enumerate(FEATURES)])


@query("j06_row_background_join", f"WITH {BASE_SQL}, {BG_SQL} SELECT r.id, round(avg({S.p_sql('b', ['r.x1', 'r.x2', 'b.x3', 'b.x4'], None)}), 6) AS mean_score FROM base r, bg b GROUP BY r.id")
def j06(spark, d):
    score = X.mean_over_background(FEATURES, background(spark, d), card_score("b"), ["x1", "x2"])
    return S.base(spark, d).select("id", score.alias("mean_score"))


@query("x05_global_importance", f"WITH {ranked_sql()} SELECT feature, round(avg(abs(contribution)), 6) AS importance FROM phi GROUP BY feature")
def x05(spark, d):
    return X.global_importance(linear(spark, d))


@query(
    "x06_top_features",
    f"""WITH {ranked_sql()} SELECT row_id, feature, round(contribution, 6) AS contribution, rank, round(({CARDS['a'][0]}::double + {' + '.join(f'{w}::double * (SELECT avg({f}) FROM base)' for f, w in zip(FEATURES, CARDS['a'][1]))}), 6) AS base_value FROM ranked WHERE rank <= 3""",
)
def x06(spark, d):
    b = S.base(spark, d)
    means = X.background_means(b, FEATURES)
    start = CARDS["a"][0] + sum(w * means[f] for f, w in zip(FEATURES, CARDS["a"][1]))
    rows = X.contribution_rows(b, "id", FEATURES, X.linear_contributions(FEATURES, CARDS["a"][1], means))
    return rows.filter("rank <= 3").select("row_id", "feature", "contribution", "rank", F.lit(start).alias("base_value"))


@query(
    "x07_risk_split",
    f"""WITH {ranked_sql()} SELECT row_id, coalesce(string_agg(feature, ',' ORDER BY rank) FILTER (WHERE rank <= 3 AND contribution > 0), '') AS top_risk_factors,
 coalesce(string_agg(feature, ',' ORDER BY rank) FILTER (WHERE rank <= 3 AND contribution < 0), '') AS top_protective_factors,
 round(sum(contribution), 6) AS prediction_impact, round(sum(abs(contribution)), 6) AS sum_abs, max(abs(contribution)) <= 1e-9 AS all_zero FROM ranked GROUP BY row_id""",
)
def x07(spark, d):
    return X.risk_split(linear(spark, d), 3)


@query(
    "x08_background_jitter",
    f"""WITH n AS (SELECT event_id, value AS x FROM events ORDER BY ts DESC, event_id DESC LIMIT 512), s AS (SELECT * FROM n ORDER BY {H.format(c='event_id', s='42')}, event_id LIMIT 192)
 SELECT event_id, round(x + greatest(abs(x) * 0.1e0, 0.05e0) * sqrt(-2e0 * ln(({H.format(c='event_id', s='x|123a')} + 0.5e0) / 4294967296e0)) * cos(6.283185307179586e0 * (({H.format(c='event_id', s='x|123b')} + 0.5e0) / 4294967296e0)), 6) AS x FROM s""",
)
def x08(spark, d):
    from cohortry.plans.catalog import table

    e = table(spark, d, "events").select("event_id", "ts", F.col("value").alias("x"))
    recent = X.newest_inputs(e, [F.desc("ts"), F.desc("event_id")], 512)
    return X.jittered_background(sample_rows(recent, ["event_id"], 192), "event_id", ["x"])


@query(
    "x08_noise_background",
    f"""WITH r AS (SELECT *, unnest(range(1, 9)) AS draw FROM (SELECT c_custkey, c_acctbal AS x FROM customer))
 SELECT c_custkey, draw::int AS draw, round(x + greatest(abs(x) * 0.25e0, 0.1e0) * sqrt(-2e0 * ln(({H.format(c='c_custkey, draw', s='x|42a')} + 0.5e0) / 4294967296e0)) * cos(6.283185307179586e0 * (({H.format(c='c_custkey, draw', s='x|42b')} + 0.5e0) / 4294967296e0)), 6) AS x FROM r""",
)
def x08b(spark, d):
    from cohortry.plans.catalog import table

    rows = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"))
    return X.noise_background(rows, "c_custkey", ["x"], n=8)


@query("x09_local_surrogates")
def x09(spark, d):
    return X.local_surrogates(S.base(spark, d), "id", FEATURES, card_score("a"), n_samples=30, top=4)


PERM_SQL = f"""{BASE_SQL}, rk AS (SELECT *, row_number() OVER (ORDER BY {H.format(c='id', s='42')}, id) AS r, count(*) OVER () AS n FROM base),
 rp AS (SELECT *, unnest(range(1, 6)) AS rep FROM rk), sh AS (SELECT *, ((r - 1 + ({H.format(c='rep', s='shift42')} % (n - 1)) + 1) % n) + 1 AS s FROM rp),
 jn AS (SELECT sh.*, dn.x1 AS d1, dn.x2 AS d2, dn.x3 AS d3, dn.x4 AS d4 FROM sh JOIN rk dn ON dn.r = sh.s),
 sc AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, rep, y, {S.p_sql('a', ['d' + g[1] if g == f else g for g in FEATURES])} AS p FROM jn" for f in FEATURES)}
 UNION ALL SELECT '', 0, y, {S.p_sql('a')} FROM base),
 g AS (SELECT feature, rep, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM sc GROUP BY 1, 2, 3),
 cu AS (SELECT *, sum(pos) OVER (PARTITION BY feature, rep ORDER BY p DESC) AS tp FROM g),
 au AS (SELECT feature, rep, sum(neg * (tp - pos / 2)) / sum(pos) / sum(neg) AS auc FROM cu GROUP BY 1, 2)"""


@query(
    "x02_permutation_importance",
    f"WITH {PERM_SQL} SELECT feature, round(avg((SELECT auc FROM au WHERE rep = 0) - auc), 6) AS importance_mean, round(stddev_pop((SELECT auc FROM au WHERE rep = 0) - auc), 6) AS importance_std FROM au WHERE rep > 0 GROUP BY feature",
)
def x02(spark, d):
    return X.permutation_importance(S.base(spark, d), "id", FEATURES, "y", lambda x: S.p("a", x), 5)


@query(
    "x02_permutation_scored_frames",
    f"WITH {PERM_SQL} SELECT feature, round(avg((SELECT auc FROM au WHERE rep = 0) - auc), 6) AS importance_mean, round(stddev_pop((SELECT auc FROM au WHERE rep = 0) - auc), 6) AS importance_std FROM au WHERE rep > 0 GROUP BY feature",
)
def x02_frames(spark, d):
    """The scorecard through the path for models that score DataFrames: all variants of all
    rows in one batch; the same permutations as x02, so the same SQL."""
    def score(df):
        return df.withColumn("score", S.p("a", {f: F.col("vec")[i] for i, f in enumerate(FEATURES)}))

    out = X.model_permutation_importance(S.base(spark, d), "id", FEATURES, "y", score, repeats=5)
    return out.select("feature", "importance_mean", "importance_std")


@query("x02_forest_permutation_importance")
def x02_forest(spark, d):
    """Drops of AUC and accuracy of a random forest fitted with the library's settings when
    each feature of every order is taken from another order, over 10 repeats. SQL cannot
    score the forest; tests/test_treeshap.py checks the metrics with numpy."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    b = S.base(spark, d).withColumn("label_index", F.col("y").cast("double"))
    model = fit_forest(b, "id", FEATURES)
    cells = T.Cells(T.node_table(spark, model).toPandas(), len(FEATURES))

    def score(df):
        return model.transform(df.withColumn("features", array_to_vector("vec"))).withColumn("score", vector_to_array("probability")[1])

    return X.model_permutation_importance(b, "id", FEATURES, "y", cells.lookup(spark, score), repeats=10)


# importance of three methods, here the three scorecards
METHOD_SQL = f"{BASE_SQL}, imp AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS method, feature, avg(abs(contribution)) AS importance FROM ({phi_sql(c)}) GROUP BY feature" for c in CARDS
) + ")"
# the scorecard features under clinical names
NAMES = {"x1": "age", "x2": "glucose", "x3": "exercise", "x4": "stress_level"}


def methods(spark, d):
    parts = [X.global_importance(linear(spark, d, c)).select(F.lit(c).alias("method"), "feature", "importance") for c in CARDS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("x01_ensemble_importance", f"WITH {METHOD_SQL}, m AS (SELECT feature, avg(importance) AS m FROM imp GROUP BY 1) SELECT feature, round(m / sum(m) OVER (), 6) AS importance FROM m")
def x01(spark, d):
    return X.ensemble_importance(methods(spark, d))


@query(
    "x10_compare_methods",
    f"WITH {METHOD_SQL} SELECT feature, " + ", ".join(f"round(coalesce(max(importance) FILTER (WHERE method = '{c}'), 0), 6) AS {c}" for c in [*CARDS, 'absent']) + " FROM imp GROUP BY feature",
)
def x10(spark, d):
    return X.compare_methods(methods(spark, d), [*CARDS, "absent"])


def named_importance(spark, d):
    imp = X.mean_of_top(methods(spark, d), 3)
    name = reduce(lambda e, kv: e.when(F.col("feature") == kv[0], kv[1]), list(NAMES.items())[1:], F.when(F.col("feature") == "x1", NAMES["x1"]))
    return imp.select(name.alias("feature"), "importance")


NAMED_SQL = f"""{METHOD_SQL}, t3 AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY importance DESC, feature) AS r FROM imp),
 ni AS (SELECT CASE feature WHEN 'x1' THEN 'age' WHEN 'x2' THEN 'glucose' WHEN 'x3' THEN 'exercise' ELSE 'stress_level' END AS feature, avg(importance) AS importance FROM t3 WHERE r <= 3 GROUP BY 1),
 gi AS (SELECT CASE feature WHEN 'age' THEN 'demographics' WHEN 'glucose' THEN 'laboratory' WHEN 'exercise' THEN 'lifestyle' ELSE 'Other' END AS grp, sum(importance) AS importance FROM ni GROUP BY 1)"""


def groups(spark):
    return literal_table(spark, [(f, g) for g, fs in X.CLINICAL_GROUPS.items() for f in fs], "feature string, grp string")


@query("a11_mean_of_top", f"WITH {NAMED_SQL} SELECT feature, round(importance, 6) AS importance FROM ni")
def a11(spark, d):
    return named_importance(spark, d)


@query("a12_grouped_importance", f"WITH {NAMED_SQL} SELECT grp, round(importance, 6) AS importance FROM gi")
def a12(spark, d):
    return X.grouped_importance(named_importance(spark, d), groups(spark))


RISK_SQL = f"""{NAMED_SQL}, rf AS (SELECT 'Primary Risk Factors' AS aspect, 'Most influential: ' || string_agg(feature, ', ' ORDER BY importance DESC, feature) AS finding FROM (SELECT * FROM ni ORDER BY importance DESC, feature LIMIT 3)
 UNION ALL SELECT 'Key Clinical Domain', (SELECT grp FROM gi WHERE grp <> 'Other' ORDER BY importance DESC, grp LIMIT 1) || ' factors most important'
 UNION ALL SELECT 'Intervention Potential', CASE WHEN coalesce(sum(importance) FILTER (WHERE feature IN ('exercise', 'stress_level')), 0) > coalesce(sum(importance) FILTER (WHERE feature = 'age'), 0)
 THEN 'High - many modifiable risk factors' ELSE 'Moderate - focus on lifestyle changes' END FROM ni)"""


@query("x11_risk_factors", f"WITH {RISK_SQL} SELECT * FROM rf")
def x11(spark, d):
    return X.risk_factors(named_importance(spark, d), groups(spark))


@query(
    "x12_insight_rows",
    f"""WITH {NAMED_SQL}, n AS (SELECT CASE feature WHEN 'age' THEN 'cp_type' WHEN 'glucose' THEN 'thalach' WHEN 'exercise' THEN 'oldpeak' ELSE 'other' END AS feature FROM ni)
 SELECT 'heart_disease_uci' AS dataset, feature, CASE feature WHEN 'cp_type' THEN 'Chest pain type is highly predictive - detailed pain assessment crucial'
 WHEN 'thalach' THEN 'Maximum heart rate achieved during exercise is significant' ELSE 'ST depression (oldpeak) indicates exercise-induced ischemia' END AS advice FROM n WHERE feature <> 'other'
 UNION ALL SELECT 'somewhere', NULL, a FROM (SELECT count(*) FROM n), (VALUES ('Focus clinical attention on high-importance features'), ('Consider feature interactions in clinical decision-making')) v(a)""",
)
def x12(spark, d):
    ni = named_importance(spark, d)
    f = F.col("feature")
    name = F.when(f == "age", "cp_type").when(f == "glucose", "thalach").when(f == "exercise", "oldpeak").otherwise("other")
    both = ni.select(F.explode(F.array(F.lit("heart_disease_uci"), F.lit("somewhere"))).alias("dataset"), name.alias("feature"))
    return X.insight_rows(both)


@query(
    "x12_key_findings",
    f"""WITH {NAMED_SQL}, t AS (SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS r FROM ni),
 a AS (SELECT string_agg(feature, ', ' ORDER BY r) AS names FROM t WHERE r <= 3)
 SELECT 'heart_disease_uci' AS dataset, 1 AS position, 'Most predictive feature: ' || feature || ' (importance: ' || printf('%.3f', importance) || ')' AS finding FROM t WHERE r = 1
 UNION ALL SELECT 'heart_disease_uci', 2, 'Top cardiovascular risk factors: ' || names FROM a
 UNION ALL SELECT 'somewhere', 1, 'Most important feature: ' || feature FROM t WHERE r = 1
 UNION ALL SELECT 'somewhere', 2, 'Top predictive features: ' || names FROM a""",
)
def x12_key(spark, d):
    ni = named_importance(spark, d)
    return X.key_findings(ni.select(F.explode(F.array(F.lit("heart_disease_uci"), F.lit("somewhere"))).alias("dataset"), "feature", "importance"))


@query(
    "x13_highest_risk_case",
    f"""WITH {ranked_sql()}, top AS (SELECT id FROM base ORDER BY {S.p_sql('a')} DESC, id LIMIT 1) SELECT row_id, feature, round(value, 9) AS value, round(contribution, 9) AS contribution, rank FROM ranked JOIN top ON id = row_id""",
    digits=9,
)
def x13(spark, d):
    """Waterfall data of the row with the highest score."""
    b = S.base(spark, d)
    means = X.background_means(b, FEATURES)
    top = b.orderBy(F.desc(S.p("a")), "id").limit(1)
    return X.contribution_rows(top, "id", FEATURES, X.linear_contributions(FEATURES, CARDS["a"][1], means))


@query("x13_dependence", f"WITH {ranked_sql()} SELECT row_id, round(value, 9) AS value, round(contribution, 9) AS contribution FROM phi WHERE feature = 'x1'", digits=9)
def x13b(spark, d):
    return linear(spark, d).filter("feature = 'x1'").select("row_id", "value", "contribution")


@query(
    "n14_monitor_advice",
    f"WITH {ranked_sql()} SELECT row_id, rank, 'Monitor ' || feature || ' closely (current: ' || (floor(value * 1000 + 0.3137) / 1000)::decimal(18, 3)::varchar || ')' AS advice FROM ranked WHERE rank <= 3 AND contribution > 0",
)
def n14(spark, d):
    return monitor_advice(linear(spark, d).withColumn("value", (F.floor(F.col("value") * 1000 + 0.3137) / 1000).cast("decimal(18,3)")))


# ---------------------------------------------------------------- voting, scoring
SOFT = " + ".join(f"{w}::double / 4 * p_{c}" for c, w in zip(CARDS, (2.0, 1.0, 1.0)))


@query("m02_soft_vote", f"WITH {SCORED_SQL}, v AS (SELECT id, 0e0 + {SOFT} AS p FROM scored) SELECT id, round(p, 8) AS p1, (round(p, 9) > 0.5)::int AS label FROM v", digits=8)
def m02(spark, d):
    s = S.scored(spark, d)
    probs = [F.array(1 - F.col(f"p_{c}"), F.col(f"p_{c}")) for c in CARDS]
    v = s.select("id", V.soft_vote(probs, [2.0, 1.0, 1.0]).alias("v")).select("id", F.transform("v", lambda x: F.round(x, 9)).alias("v"))
    return v.select("id", F.col("v")[1].alias("p1"), V.argmax(F.col("v")).alias("label"))


HARD = " + ".join(f"(p_{c} >= 0.5)::int" for c in CARDS)


@query("m03_hard_vote", f"WITH {SCORED_SQL} SELECT id, ({HARD} >= 2)::int AS label, CASE WHEN (p_a >= 0.5) = (p_b >= 0.5) THEN (p_a >= 0.5)::int ELSE 0 END AS tie_label FROM scored")
def m03(spark, d):
    labels = [(F.col(f"p_{c}") >= 0.5).cast("int") for c in CARDS]
    return S.scored(spark, d).select("id", V.hard_vote(labels).alias("label"), V.hard_vote(labels[:2]).alias("tie_label"))


@query("m12_batch_scoring", f"WITH {SCORED_SQL} SELECT id, (p_a > 0.5)::int AS prediction, round(1 - p_a, 6) AS p0, p_a AS p1, round(greatest(p_a, 1 - p_a), 6) AS confidence, md5(concat_ws('|', id, 'trace')) AS trace_id FROM scored")
def m12(spark, d):
    from cohortry.operators.models import score_output

    s = S.scored(spark, d).withColumn("probability", F.array(1 - F.col("p_a"), F.col("p_a")))
    return score_output(s, "id").select(
        "id", "prediction", F.col("probability")[0].alias("p0"), F.col("probability")[1].alias("p1"), "confidence", "trace_id"
    )
