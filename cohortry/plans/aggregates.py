"""Aggregations (A) and joins (J) of the longitudinal build, and the whole build."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.functions.clinical import CONCEPTS, NO_CONCEPT
from cohortry.operators import longitudinal as L
from cohortry.plans import roles as R
from cohortry.plans.catalog import query, table
from cohortry.plans.roles import COND_SQL, ENC_SQL, OBS_CODES, OBS_SQL


def concept_case(text: str) -> str:
    """SQL: 0-based index of the first matching concept."""
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in c[3]) + f" THEN {i}"
        for i, c in enumerate(CONCEPTS)
    )
    return f"(CASE {arms} ELSE {len(CONCEPTS)} END)"


def concept_values(pos: int, index: str) -> str:
    vals = ", ".join("'" + c[pos] + "'" for c in [*CONCEPTS, NO_CONCEPT])
    return f"([{vals}])[{index} + 1]"


A1 = """SELECT patient, count(*) AS n_encounters, count(DISTINCT cls) AS unique_encounter_classes,
 min(start_ts) AS first_encounter_start, max(stop_ts) AS last_encounter_end,
 round(avg(dur), 6) AS avg_encounter_duration_days, round(quantile_cont(dur, 0.5), 6) AS median_encounter_duration_days,
 count(*) FILTER (WHERE cls = 'emergency') AS emergency_encounter_count
 FROM (SELECT *, coalesce((epoch_us(stop_ts) - epoch_us(start_ts)) / 86400e6, 0) AS dur FROM enc) GROUP BY patient"""
A2 = """SELECT patient, count(*) AS n_conditions, count(DISTINCT code) AS n_unique_condition_codes,
 count(*) FILTER (WHERE stop_ts IS NULL) AS n_chronic_conditions FROM cond GROUP BY patient"""
A3 = """SELECT patient, count(*) AS n_medications, count(DISTINCT code) AS n_unique_medication_codes,
 count(*) FILTER (WHERE stop_ts IS NULL) AS n_active_medications FROM cond WHERE flag = 'R' GROUP BY patient"""
A5 = "SELECT patient, count(try_cast(value AS DOUBLE)) AS numeric_observation_count, " + ", ".join(
    f"round(avg(v) FILTER (WHERE code = '{c}'), 6) AS {c}_mean, max(v) FILTER (WHERE code = '{c}') AS {c}_max, "
    f"min(v) FILTER (WHERE code = '{c}') AS {c}_min, arg_max(v, (ts, id)) FILTER (WHERE code = '{c}' AND v IS NOT NULL) AS {c}_last"
    for c in OBS_CODES
) + " FROM (SELECT *, try_cast(value AS DOUBLE) AS v FROM obs) GROUP BY patient"
A7 = f"""SELECT patient, coalesce(min(domain) FILTER (WHERE r = 1 AND domain <> 'General'), 'General') AS dominant_condition_domain FROM (
 SELECT patient, domain, row_number() OVER (PARTITION BY patient ORDER BY (domain = 'General'), n DESC, domain) AS r FROM (
 SELECT patient, {concept_values(0, concept_case("coalesce(description, '')"))} AS domain, count(*) AS n FROM cond GROUP BY 1, 2)) GROUP BY patient"""


def _a8(out: str, where: str = "true") -> str:
    return f"""SELECT patient, string_agg(description, ' | ' ORDER BY r) || CASE WHEN max(n) > 5 THEN ' | (+' || (max(n) - 5)::varchar || ' more)' ELSE '' END AS {out}
 FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY start_ts, ok, ln, code, sk) AS r, count(*) OVER (PARTITION BY patient) AS n
 FROM cond WHERE description <> '' AND {where}) WHERE r <= 5 GROUP BY patient"""


TL_SQL = """tl AS (SELECT * FROM (
 SELECT patient, start_ts AS event_date, 'encounter' AS event_type, coalesce(cls, 'unknown') AS event_label FROM enc
 UNION ALL SELECT patient, start_ts, 'condition', coalesce(description, 'unknown') FROM cond
 UNION ALL SELECT patient, start_ts, 'medication', coalesce(description, 'unknown') FROM cond WHERE flag = 'R'
 UNION ALL SELECT patient, stop_ts, 'procedure', coalesce(flag, 'unknown') FROM cond
 UNION ALL SELECT patient, stop_ts, 'careplan', coalesce(cls, 'unknown') FROM enc
 UNION ALL SELECT patient, ts, 'immunization', coalesce(code, 'unknown') FROM obs) WHERE event_date IS NOT NULL)"""
W3 = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY event_date, event_type, event_label) AS position FROM tl) WHERE position <= 50"


def timeline(enc, cond, obs):
    kind = L.EventKind
    return L.timeline(
        [
            (enc, [kind("encounter", "start", "class"), kind("careplan", "stop", "class")]),
            (
                cond,
                [
                    kind("condition", "start", "description"),
                    kind("medication", "start", "description", "flag = 'R'"),
                    kind("procedure", "stop", "flag"),
                ],
            ),
            (obs, [kind("immunization", "ts", "code")]),
        ]
    )


def tables(spark, d):
    return R.encounters(spark, d), R.conditions(spark, d), R.observations(spark, d)


ORDER = ["start", "ok", "ln", "code", "sk"]


def longitudinal_parts(spark, d):
    enc, cond, obs = tables(spark, d)
    enc, cond = L.joined_once(enc.drop("id", "cost")), L.joined_once(cond)
    return [
        L.encounter_features(enc),
        L.code_features(cond, [*R.CONDITION_COUNTS, *R.MEDICATION_COUNTS]),
        L.summary_lists(cond, "description", ORDER, {"condition_summary": None, "medication_summary": "flag = 'R'"}),
        L.dominant_domain(cond, "description"),
        L.observation_features(obs, OBS_CODES),
        timeline(enc, cond, obs).groupBy("patient").agg(F.count(F.lit(1)).alias("temporal_event_count")),
    ]


FULL_SQL = f"""WITH {ENC_SQL}, {COND_SQL}, {OBS_SQL}, {TL_SQL}, a1 AS ({A1}), a2 AS ({A2}), a3 AS ({A3}), a5 AS ({A5}), a7 AS ({A7}),
 a8c AS ({_a8("condition_summary")}), a8m AS ({_a8("medication_summary", "flag = 'R'")}),
 a6 AS (SELECT patient, count(*) AS temporal_event_count FROM tl GROUP BY 1),
 j AS (SELECT c_custkey AS patient, c_mktsegment, c_acctbal, n_encounters, unique_encounter_classes, first_encounter_start, last_encounter_end,
 avg_encounter_duration_days, median_encounter_duration_days, emergency_encounter_count, n_conditions, n_unique_condition_codes, n_chronic_conditions,
 n_medications, n_unique_medication_codes, n_active_medications, coalesce(condition_summary, '') AS condition_summary,
 coalesce(medication_summary, '') AS medication_summary, coalesce(dominant_condition_domain, 'General') AS dominant_condition_domain,
 coalesce(numeric_observation_count, 0) AS numeric_observation_count, {", ".join(f"{c}_{s}" for c in OBS_CODES for s in ("mean", "max", "min", "last"))},
 coalesce(temporal_event_count, 0) AS temporal_event_count,
 greatest(coalesce(floor((epoch_us(last_encounter_end) - epoch_us(first_encounter_start)) / 86400e6), 0), 0)::bigint AS encounter_time_span_days,
 round(ln(1 + coalesce(n_encounters, 0) + coalesce(n_chronic_conditions, 0) * 1.5::double + coalesce(n_active_medications, 0)), 3) AS longitudinal_complexity_score
 FROM customer LEFT JOIN a1 ON a1.patient = c_custkey LEFT JOIN a2 ON a2.patient = c_custkey LEFT JOIN a3 ON a3.patient = c_custkey
 LEFT JOIN a5 ON a5.patient = c_custkey LEFT JOIN a6 ON a6.patient = c_custkey LEFT JOIN a7 ON a7.patient = c_custkey
 LEFT JOIN a8c ON a8c.patient = c_custkey LEFT JOIN a8m ON a8m.patient = c_custkey)
 SELECT *, (coalesce(n_encounters, 0) >= 5 OR coalesce(n_chronic_conditions, 0) >= 3 OR coalesce(n_active_medications, 0) >= 4 OR encounter_time_span_days >= 365)::int AS target FROM j"""


@query("a00_longitudinal_patients", FULL_SQL)
def a00(spark, d):
    """The whole longitudinal patient table."""
    p = longitudinal_parts(spark, d)
    pats = R.patients(spark, d).select("patient", "c_mktsegment", "c_acctbal")
    df = L.add_outcomes(L.attach(pats, p))
    df = df.withColumns(
        {
            "condition_summary": F.coalesce("condition_summary", F.lit("")),
            "medication_summary": F.coalesce("medication_summary", F.lit("")),
            "dominant_condition_domain": F.coalesce("dominant_condition_domain", F.lit("General")),
            "numeric_observation_count": F.coalesce("numeric_observation_count", F.lit(0)),
            "temporal_event_count": F.coalesce("temporal_event_count", F.lit(0)),
        }
    )
    return df


@query("a01_encounters_per_patient", f"WITH {ENC_SQL} {A1}")
def a01(spark, d):
    return L.encounter_features(R.encounters(spark, d))


@query("a02_conditions_per_patient", f"WITH {COND_SQL} {A2}")
def a02(spark, d):
    return L.code_features(R.conditions(spark, d), R.CONDITION_COUNTS)


@query("a03_medications_per_patient", f"WITH {COND_SQL} {A3}")
def a03(spark, d):
    return L.code_features(R.medications(spark, d), R.MEDICATION_COUNTS)


@query("a04_numeric_observations", f"WITH {OBS_SQL} SELECT patient, count(try_cast(value AS DOUBLE)) AS numeric_observation_count FROM obs GROUP BY patient")
def a04(spark, d):
    return L.observation_features(R.observations(spark, d), {})


@query("a05_observation_pivot", f"WITH {OBS_SQL} {A5}")
def a05(spark, d):
    return L.observation_features(R.observations(spark, d), OBS_CODES)


@query("a06_events_per_patient", f"WITH {ENC_SQL}, {COND_SQL}, {OBS_SQL}, {TL_SQL} SELECT patient, count(*) AS temporal_event_count FROM tl GROUP BY patient")
def a06(spark, d):
    return timeline(*tables(spark, d)).groupBy("patient").agg(F.count(F.lit(1)).alias("temporal_event_count"))


@query("a07_dominant_domain", f"WITH {COND_SQL} {A7}")
def a07(spark, d):
    return L.dominant_domain(R.conditions(spark, d), "description")


@query("a08_summary_list", f"WITH {COND_SQL} {_a8('condition_summary')}")
def a08(spark, d):
    return L.summary_list(R.conditions(spark, d), "description", ORDER, "condition_summary")


# order status and priority stand for model and dataset of a result table
@query(
    "a09_group_means",
    """SELECT 'model' AS grouping, o_orderstatus AS name, round(avg(o_totalprice), 4) AS mean_value, count(*) AS n FROM orders GROUP BY o_orderstatus
 UNION ALL SELECT 'dataset', o_orderpriority, round(avg(o_totalprice), 4), count(*) FROM orders GROUP BY o_orderpriority""",
    digits=4,
)
def a09(spark, d):
    from cohortry.operators.reports import group_means

    o = table(spark, d, "orders")
    return group_means(o, {"model": "o_orderstatus", "dataset": "o_orderpriority"}, "o_totalprice")


@query(
    "j01_left_join_chain",
    f"""WITH {ENC_SQL}, {COND_SQL}, a2 AS ({A2}), a3 AS ({A3}), e AS (SELECT patient, count(*) AS n_encounters FROM enc GROUP BY 1)
 SELECT c_custkey AS patient, c_nationkey, n_encounters, n_conditions, n_unique_condition_codes, n_chronic_conditions, n_medications,
 n_unique_medication_codes, n_active_medications FROM customer LEFT JOIN e ON e.patient = c_custkey
 LEFT JOIN a2 ON a2.patient = c_custkey LEFT JOIN a3 ON a3.patient = c_custkey""",
)
def j01(spark, d):
    e = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("patient")).agg(F.count(F.lit(1)).alias("n_encounters"))
    pats = R.patients(spark, d).select("patient", "c_nationkey")
    return L.attach(pats, [e, L.code_features(R.conditions(spark, d), [*R.CONDITION_COUNTS, *R.MEDICATION_COUNTS])])


@query(
    "j02_observation_join",
    f"WITH {OBS_SQL}, a5 AS ({A5}) SELECT c_custkey AS patient, a5.* EXCLUDE (patient) FROM customer LEFT JOIN a5 ON a5.patient = c_custkey",
)
def j02(spark, d):
    """All observation blocks in one aggregate and one join."""
    return L.attach(R.patients(spark, d).select("patient"), [a05(spark, d)])


@query(
    "j03_keyed_lookup",
    "SELECT c_custkey, c_nationkey, coalesce(n_name, 'Unknown') AS nation, coalesce(r_name, 'Unknown') AS region "
    "FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20 LEFT JOIN region ON r_regionkey = n_regionkey",
)
def j03(spark, d):
    from cohortry.operators.lookup import lookup

    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").filter("n_nationkey < 20")
    names = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), "n_regionkey")
    out = lookup(c, names, ["c_nationkey"], {"nation": F.lit("Unknown")})
    reg = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    return lookup(out, reg, ["n_regionkey"], {"region": F.lit("Unknown")}).drop("n_regionkey")


@query("j04_event_timeline", f"WITH {ENC_SQL}, {COND_SQL}, {OBS_SQL}, {TL_SQL} SELECT patient, event_date, event_type, event_label FROM tl")
def j04(spark, d):
    return timeline(*tables(spark, d))


@query("w03_first_events", f"WITH {ENC_SQL}, {COND_SQL}, {OBS_SQL}, {TL_SQL} {W3}")
def w03(spark, d):
    return L.first_events(timeline(*tables(spark, d)))


@query(
    "w03_event_summary",
    f"""WITH {ENC_SQL}, {COND_SQL}, {OBS_SQL}, {TL_SQL}, h AS ({W3})
 SELECT patient, '[' || string_agg('{{"date":"' || strftime(event_date, '%Y-%m-%dT%H:%M:%S') || '","type":"' || event_type || '","label":"' || event_label || '"}}', ',' ORDER BY position) || ']' AS temporal_event_summary
 FROM h GROUP BY patient""",
)
def w03b(spark, d):
    return L.event_summary(timeline(*tables(spark, d)))


@query(
    "w05_last_value",
    "SELECT user_id AS patient, event_type AS code, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1, 2",
)
def w05(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("patient"), F.col("event_type").alias("code")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("last_value")
    )
