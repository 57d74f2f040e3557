"""Projections, filters and scalar functions (P)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.functions import clinical as C
from cohortry.functions import numeric as N
from cohortry.functions import text as T
from cohortry.operators import encode, longitudinal as L
from cohortry.operators.sequence import sequential_id
from cohortry.operators.lookup import literal_table, lookup
from cohortry.plans import roles as R
from cohortry.plans.aggregates import A1, A2, A3, concept_case, concept_values
from cohortry.plans.catalog import query, table
from cohortry.plans.roles import COND_SQL, ENC_SQL

WS_SQL = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]+"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x}, ''), '^{WS_SQL}', ''), '{WS_SQL}$', '')"


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS_SQL}'), lambda w: w <> '')"


def case_map(col: str, mapping: dict) -> str:
    arms = " ".join(f"WHEN {col} = '{k}' THEN {v!r}" for k, v in mapping.items())
    return f"CASE {arms} END"


@query(
    "p01_binarize",
    """SELECT o_orderkey, (o_totalprice > 250000)::int AS above, coalesce(nullif(o_orderstatus, 'P') = 'F', false)::int AS is_f,
 (o_custkey = 2)::int AS is_two, (CASE WHEN o_orderpriority = '1-URGENT' THEN 'Yes' ELSE 'No' END = 'Yes')::int AS is_yes FROM orders""",
)
def p01(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    yes = F.when(F.col("o_orderpriority") == "1-URGENT", "Yes").otherwise("No")
    return o.select(
        "o_orderkey",
        N.flag(F.col("o_totalprice") > 250000).alias("above"),
        N.flag(status == "F").alias("is_f"),
        N.flag(F.col("o_custkey") == 2).alias("is_two"),
        N.flag(yes == "Yes").alias("is_yes"),
    )


@query(
    "p02_collapse_target",
    "SELECT d.doc_id, CASE WHEN quality = 0 THEN 0 ELSE 1 END AS target FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def p02(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(table(spark, d, "labels"), "doc_id", "left").select(
        "doc_id", encode.collapse_target(F.col("quality")).alias("target")
    )


BAND_SQL = "'[' || ((p_size // 10) * 10)::varchar || '-' || ((p_size // 10) * 10 + 10)::varchar || ')'"
EFFECT_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Highly Effective' WHEN '2-HIGH' THEN 'Considerably Effective' WHEN '4-NOT SPECIFIED' THEN 'Ineffective' ELSE 'other' END"
SIDE_SQL = "CASE o_orderstatus WHEN 'F' THEN 'No Side Effects' WHEN 'O' THEN 'Severe Side Effects' END"


def effect_col():
    p = F.col("o_orderpriority")
    return (
        F.when(p == "1-URGENT", "Highly Effective").when(p == "2-HIGH", "Considerably Effective")
        .when(p == "4-NOT SPECIFIED", "Ineffective").otherwise("other")
    )


def side_col():
    s = F.col("o_orderstatus")
    return F.when(s == "F", "No Side Effects").when(s == "O", "Severe Side Effects")


@query(
    "p03_value_map",
    f"SELECT p_partkey, {case_map(BAND_SQL, C.AGE_BANDS)} AS age_numeric, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 2 END AS race_numeric FROM part",
)
def p03(spark, d):
    band = F.concat(F.lit("["), (F.floor(F.col("p_size") / 10) * 10).cast("string"), F.lit("-"),
                    (F.floor(F.col("p_size") / 10) * 10 + 10).cast("string"), F.lit(")"))
    kind = F.when(F.col("p_type") == "ECONOMY", "Caucasian").when(F.col("p_type") == "LARGE", "Hispanic").otherwise("none of these")
    return table(spark, d, "part").select(
        "p_partkey",
        C.value_map(band, C.AGE_BANDS).alias("age_numeric"),
        C.value_map(kind, C.RACE_CODES).alias("race_numeric"),
    )


@query("p04_no_to_zero", "SELECT o_orderkey, CASE WHEN CASE o_orderstatus WHEN 'O' THEN 'NO' ELSE '<30' END = 'NO' THEN 0 ELSE 1 END AS target FROM orders")
def p04(spark, d):
    raw = F.when(F.col("o_orderstatus") == "O", "NO").otherwise("<30")
    return table(spark, d, "orders").select("o_orderkey", F.when(raw == "NO", 0).otherwise(1).alias("target"))


@query("p05_select_rename", "SELECT n_name AS site, n_nationkey AS site_id, c_custkey AS patient_id, c_acctbal AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey")
def p05(spark, d):
    c = table(spark, d, "customer").withColumnsRenamed({"c_custkey": "patient_id", "c_acctbal": "balance"})
    n = table(spark, d, "nation").withColumnsRenamed({"n_name": "site", "n_nationkey": "site_id"})
    return c.join(n, c.c_nationkey == n.site_id).select("site", "site_id", "patient_id", "balance")


@query("p06_normalize_names", "SELECT s_suppkey AS supp_key, s_name AS supp_name, s_acctbal AS acct_bal FROM supplier")
def p06(spark, d):
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("Supp-Key"), F.col("s_name").alias("Supp Name"), F.col("s_acctbal").alias("ACCT-BAL")
    )
    return s.toDF(*T.normalized_names(s.columns))


@query("p07_sequential_id", "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS patient_id, o_orderkey, o_orderdate FROM orders")
def p07(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return sequential_id(o, ["o_orderdate", "o_orderkey"], "patient_id")


@query(
    "p08_numeric_coercion",
    """SELECT event_id, try_cast(CASE WHEN value < 5 THEN 'low' ELSE value::varchar END AS DOUBLE) AS value_numeric,
 try_cast(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS event_number FROM events""",
)
def p08(spark, d):
    v = F.when(F.col("value") < 5, "low").otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select(
        "event_id",
        N.to_number(v).alias("value_numeric"),
        N.to_number(F.get_json_object("props", "$.k")).alias("k"),
        N.to_number(F.col("event_type")).alias("event_number"),
    )


FACT_SQL = """f AS (SELECT v, row_number() OVER (ORDER BY first_key, v) - 1 AS code FROM (
 SELECT {col} AS v, min({key}) AS first_key FROM {tab} WHERE {col} IS NOT NULL GROUP BY 1))"""


@query(
    "p09_factorize",
    "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS label FROM orders), "
    + FACT_SQL.format(col="label", key="o_orderkey", tab="o")
    + " SELECT o_orderkey, label, coalesce(code, -1)::bigint AS label_code FROM o LEFT JOIN f ON f.v = label",
)
def p09(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("label")
    )
    return encode.factorize(o, "label", "o_orderkey", "label_code")


@query(
    "p10_yes_no_detect",
    "WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Yes' WHEN 'F' THEN 'No' END AS fever, o_orderpriority AS contact FROM orders), "
    + FACT_SQL.format(col="contact", key="o_orderkey", tab="o")
    + " SELECT o_orderkey, coalesce(fever = 'Yes', false)::bigint AS fever, coalesce(code, -1)::bigint AS contact FROM o LEFT JOIN f ON f.v = contact",
)
def p10(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "O", "Yes").when(F.col("o_orderstatus") == "F", "No").alias("fever"),
        F.col("o_orderpriority").alias("contact"),
    )
    return encode.encode_yes_no(o, ["fever", "contact"], "o_orderkey")


@query(
    "p11_symptom_target",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ((l_quantity > 25)::int + (l_discount > 0.05)::int + (l_tax > 0.04)::int >= 2)::int AS target,
 (l_returnflag = 'R')::int AS named_target FROM lineitem""",
)
def p11(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        N.flag(F.col("l_quantity") > 25).alias("cough"),
        N.flag(F.col("l_discount") > 0.05).alias("fever"),
        N.flag(F.col("l_tax") > 0.04).alias("fatigue"),
        "l_returnflag",
    )
    out = li.withColumn("target", N.symptom_target(li, ["cough", "fever", "fatigue"]))
    named = out.withColumn("covid_positive", N.flag(F.col("l_returnflag") == "R"))
    return named.withColumn("named_target", N.symptom_target(named, [])).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "target", "named_target"
    )


@query("p12_text_clean", f"SELECT doc_id, {strip_sql('CASE WHEN doc_id % 7 = 3 THEN NULL ELSE chr(10) || text || chr(9) END')} AS text FROM documents")
def p12(spark, d):
    raw = F.when(F.col("doc_id") % 7 == 3, F.lit(None)).otherwise(F.concat(F.lit("\n"), "text", F.lit("\t")))
    return table(spark, d, "documents").select("doc_id", T.clean(raw).alias("text"))


@query("p13_text_lengths", f"SELECT doc_id, length(text) AS char_length, len({words_sql('text')}) AS word_count FROM documents")
def p13(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.length("text").cast("bigint").alias("char_length"), T.word_count(F.col("text")).cast("bigint").alias("word_count")
    )


# consecutive turns of a conversation stand for question pairs
PAIR_SQL = f"""pairs AS (SELECT a.conv_id, a.turn, {strip_sql('a.text')} AS q1, {strip_sql('b.text')} AS q2
 FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


def pairs(spark, d):
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), T.clean(F.col("text")).alias("q2"))
    return c.select("conv_id", "turn", T.clean(F.col("text")).alias("q1")).join(nxt, ["conv_id", "turn"])


@query("p14_total_words", f"WITH {PAIR_SQL} SELECT conv_id, turn, len({words_sql('q1')}) + len({words_sql('q2')}) AS total_word_count FROM pairs")
def p14(spark, d):
    total = T.word_count(F.col("q1")) + T.word_count(F.col("q2"))
    return pairs(spark, d).select("conv_id", "turn", total.cast("bigint").alias("total_word_count"))


@query(
    "p15_length_ratio",
    f"WITH {PAIR_SQL} SELECT conv_id, turn, round(least(greatest(length(q1), 1), greatest(length(q2), 1)) / greatest(length(q1), length(q2), 1), 6) AS length_ratio FROM pairs",
)
def p15(spark, d):
    return pairs(spark, d).select("conv_id", "turn", T.length_ratio(F.length("q1"), F.length("q2")).alias("length_ratio"))


@query(
    "p16_token_jaccard",
    f"""WITH {PAIR_SQL}, s AS (SELECT conv_id, turn, list_distinct({words_sql('lower(q1)')}) AS a, list_distinct({words_sql('lower(q2)')}) AS b FROM pairs)
 SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::double
 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) END AS token_jaccard FROM s""",
)
def p16(spark, d):
    return pairs(spark, d).select("conv_id", "turn", T.token_jaccard(F.col("q1"), F.col("q2")).alias("token_jaccard"))


@query(
    "p17_text_concept",
    f"""WITH x AS (SELECT doc_id, {concept_case('text')} AS i FROM documents)
 SELECT doc_id, {concept_values(1, 'i')} AS code, {concept_values(2, 'i')} AS name, {concept_values(0, 'i')} AS domain FROM x""",
)
def p17(spark, d):
    x = table(spark, d, "documents").select("doc_id", C.concept_index("text").alias("i"))
    return x.select("doc_id", *[C.concept_field(F.col("i"), f).alias(f) for f in ("code", "name", "domain")])


TITLES = {c[0]: c[0].title() for c in C.CONCEPTS} | {"General": "General"}


@query(
    "p18_pair_alignment",
    f"""WITH {PAIR_SQL}, x AS (SELECT conv_id, turn, {concept_case('q1')} AS i, {concept_case('q2')} AS j FROM pairs)
 SELECT conv_id, turn, (i = j)::int AS concept_alignment, (i < {len(C.CONCEPTS)} OR j < {len(C.CONCEPTS)})::int AS has_ontology_match,
 CASE WHEN i = j THEN {concept_values(0, 'i')} ELSE 'Mixed/Unaligned' END AS shared_concept_domain,
 {case_map(concept_values(0, 'i'), TITLES)} || ' ↔ ' || {case_map(concept_values(0, 'j'), TITLES)} AS concept_pair_summary FROM x""",
)
def p18(spark, d):
    x = pairs(spark, d).select("conv_id", "turn", C.concept_index("q1").alias("i"), C.concept_index("q2").alias("j"))
    none = len(C.CONCEPTS)
    di, dj = C.concept_field(F.col("i"), "domain"), C.concept_field(F.col("j"), "domain")
    return x.select(
        "conv_id", "turn",
        N.flag(F.col("i") == F.col("j")).alias("concept_alignment"),
        N.flag((F.col("i") < none) | (F.col("j") < none)).alias("has_ontology_match"),
        F.when(F.col("i") == F.col("j"), di).otherwise("Mixed/Unaligned").alias("shared_concept_domain"),
        F.concat(F.initcap(di), F.lit(" ↔ "), F.initcap(dj)).alias("concept_pair_summary"),
    )


DRUGS = [*C.DRUG_CODES, "placebo", "aspirin"]
LESIONS = [*C.LESION_CODES, "freckle"]


@query(
    "p19_code_lookup",
    f"""WITH x AS (SELECT p_partkey, (['{"', '".join(DRUGS)}'])[p_partkey % {len(DRUGS)} + 1] AS drug, (['{"', '".join(LESIONS)}'])[p_partkey % {len(LESIONS)} + 1] AS lesion FROM part)
 SELECT p_partkey, drug, lesion, coalesce({case_map('drug', C.DRUG_CODES)}, 'RXNORM:UNKNOWN') AS rxnorm,
 coalesce({case_map('lesion', {k: v[0] for k, v in C.LESION_CODES.items()})}, 'UNKNOWN') AS icd10,
 coalesce({case_map('lesion', {k: v[1] for k, v in C.LESION_CODES.items()})}, 'unknown') AS risk FROM x""",
)
def p19(spark, d):
    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % len(values) + 1).cast("int"))

    x = table(spark, d, "part").select("p_partkey", pick(DRUGS).alias("drug"), pick(LESIONS).alias("lesion"))
    out = x.withColumn("rxnorm", C.value_map(F.lower("drug"), C.DRUG_CODES, F.lit(C.UNKNOWN_DRUG)))
    codes = literal_table(spark, [(k, *v) for k, v in C.LESION_CODES.items()], "lesion string, icd10 string, risk string")
    return lookup(out, codes, ["lesion"], {"icd10": F.lit("UNKNOWN"), "risk": F.lit("unknown")})


@query(
    "p20_score_difference",
    f"""WITH x AS (SELECT o_orderkey, o_totalprice AS rating, {case_map(EFFECT_SQL, C.EFFECTIVENESS)} AS e, {case_map(SIDE_SQL, C.SIDE_EFFECTS)} AS s FROM orders)
 SELECT o_orderkey, round(rating - coalesce(s, 0), 6) AS net_rating_vs_side_effects, coalesce(e, 0) - coalesce(s, 0) AS effectiveness_minus_side_effects FROM x""",
)
def p20(spark, d):
    e = C.value_map(effect_col(), C.EFFECTIVENESS)
    s = C.value_map(side_col(), C.SIDE_EFFECTS)
    return table(spark, d, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") - N.zero(s)).alias("net_rating_vs_side_effects"),
        (N.zero(e) - N.zero(s)).alias("effectiveness_minus_side_effects"),
    )


@query(
    "p21_days_between",
    f"WITH {ENC_SQL} SELECT id, floor((epoch_us(stop_ts - INTERVAL 6 HOUR) - epoch_us(start_ts)) / 86400e6)::bigint AS waiting_days FROM enc",
)
def p21(spark, d):
    stop = F.col("stop") - F.expr("INTERVAL 6 HOUR")
    return R.encounters(spark, d).select("id", N.days_between(F.col("start"), stop).alias("waiting_days"))


@query(
    "p22_duration_days",
    f"WITH {ENC_SQL} SELECT id, round(coalesce((epoch_us(stop_ts + INTERVAL 90 MINUTE) - epoch_us(start_ts)) / 86400e6, 0), 6) AS duration_days FROM enc",
)
def p22(spark, d):
    stop = F.col("stop") + F.expr("INTERVAL 90 MINUTE")
    return R.encounters(spark, d).select("id", N.duration_days(F.col("start"), stop).alias("duration_days"))


@query(
    "p23_span_days",
    f"""WITH {ENC_SQL}, s AS (SELECT patient, min(start_ts) AS f, max(stop_ts) AS l FROM enc GROUP BY 1)
 SELECT patient, greatest(coalesce(floor((epoch_us(l) - epoch_us(f)) / 86400e6), 0), 0)::bigint AS encounter_time_span_days FROM s""",
)
def p23(spark, d):
    s = R.encounters(spark, d).groupBy("patient").agg(F.min("start").alias("f"), F.max("stop").alias("l"))
    return s.select("patient", N.span_days(F.col("f"), F.col("l")).alias("encounter_time_span_days"))


@query(
    "p24_age_at_reference",
    f"""WITH {ENC_SQL}, s AS (SELECT patient, max(stop_ts) AS l FROM enc GROUP BY 1), b AS (
 SELECT c_custkey AS patient, CASE WHEN c_custkey % 11 <> 0 THEN TIMESTAMP '1930-01-01' + to_days((c_custkey * 37 % 20000)::int) END AS birth FROM customer)
 SELECT b.patient, coalesce(round(round(floor((epoch_us(coalesce(l, TIMESTAMP '2024-01-01')) - epoch_us(birth)) / 86400e6) / 365.25::double, 9), 1), 0) AS age_at_last_encounter_years
 FROM b LEFT JOIN s ON s.patient = b.patient""",
)
def p24(spark, d):
    s = R.encounters(spark, d).groupBy("patient").agg(F.max("stop").alias("l"))
    birth = F.when(
        F.col("patient") % 11 != 0, F.date_add(F.lit("1930-01-01").cast("date"), (F.col("patient") * 37 % 20000).cast("int"))
    )
    b = R.patients(spark, d).select("patient", birth.alias("birth"))
    age = N.age_years(F.col("birth"), F.col("l").cast("timestamp"), F.lit("2024-01-01").cast("timestamp"))
    return b.join(s, "patient", "left").select("patient", age.alias("age_at_last_encounter_years"))


RULE_SQL = f"""WITH {ENC_SQL}, {COND_SQL}, a2 AS ({A2}), a3 AS ({A3}), e AS (SELECT patient, count(*) AS n, min(start_ts) AS f, max(stop_ts) AS l FROM enc GROUP BY 1),
 j AS (SELECT c_custkey AS patient, coalesce(n, 0) AS n, coalesce(n_chronic_conditions, 0) AS c, coalesce(n_active_medications, 0) AS m,
 greatest(coalesce(floor((epoch_us(l) - epoch_us(f)) / 86400e6), 0), 0) AS span
 FROM customer LEFT JOIN e ON e.patient = c_custkey LEFT JOIN a2 ON a2.patient = c_custkey LEFT JOIN a3 ON a3.patient = c_custkey)"""


def rule_input(spark, d):
    e = R.encounters(spark, d).groupBy("patient").agg(
        F.count(F.lit(1)).alias("n_encounters"), F.min("start").alias("first_encounter_start"), F.max("stop").alias("last_encounter_end")
    )
    counts = L.code_features(R.conditions(spark, d), [*R.CONDITION_COUNTS, *R.MEDICATION_COUNTS])
    return L.add_outcomes(L.attach(R.patients(spark, d).select("patient"), [e, counts]))


@query("p25_complexity_score", f"{RULE_SQL} SELECT patient, round(ln(1 + n + 1.5::double * c + m), 3) AS longitudinal_complexity_score FROM j")
def p25(spark, d):
    return rule_input(spark, d).select("patient", "longitudinal_complexity_score")


@query("p26_high_utilization", f"{RULE_SQL} SELECT patient, (n >= 5 OR c >= 3 OR m >= 4 OR span >= 365)::int AS target FROM j")
def p26(spark, d):
    return rule_input(spark, d).select("patient", "target")


@query(
    "p27_gender_code",
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS gender_code, (c_acctbal < 0)::int AS has_death_date FROM customer",
)
def p27(spark, d):
    g = F.when(F.col("c_mktsegment") == "BUILDING", "m").when(F.col("c_mktsegment") == "MACHINERY", "F").when(F.col("c_mktsegment") == "HOUSEHOLD", "other")
    death = F.when(F.col("c_acctbal") < 0, F.lit("2001-01-01"))
    return table(spark, d, "customer").select(
        "c_custkey", C.binary_code(g).alias("gender_code"), N.flag(death.isNotNull()).alias("has_death_date")
    )


@query(
    "p28_label_pattern",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'hyper' WHEN '2-HIGH' THEN 'hypo' WHEN '3-MEDIUM' THEN 'normal' WHEN '5-LOW' THEN 'normal' ELSE 'sick' END AS target FROM orders""",
)
def p28(spark, d):
    raw = C.value_map(
        F.col("o_orderpriority"),
        {"1-URGENT": "Hyperthyroid", "2-HIGH": "primary HYPOthyroid", "3-MEDIUM": "Negative", "5-LOW": "Normal result"},
        F.lit("Sick"),
    )
    return table(spark, d, "orders").select("o_orderkey", C.label_pattern(raw).alias("target"))


@query(
    "p29_rescale_clip",
    """SELECT c_custkey, round_even(least(greatest(x * 15 + 55, 18), 90), 0) AS age, round_even(round(least(greatest(x * 8 + 25, 15), 50), 9), 1) AS bmi
 FROM (SELECT c_custkey, (c_acctbal - 4500) / 3000 AS x FROM customer)""",
)
def p29(spark, d):
    x = (F.col("c_acctbal") - 4500) / 3000
    return table(spark, d, "customer").select(
        "c_custkey", N.rescale_clip(x, 15.0, 55.0, 18.0, 90.0, 0).alias("age"), N.rescale_clip(x, 8.0, 25.0, 15.0, 50.0, 1).alias("bmi")
    )


SIZES = ["< 1 GB", "250 MB", "3 GB", "45 GB total", "unknown"]
TIMES = ["20 min", "4 hours", "30 hours", "2-3 days"]


@query(
    "p30_catalogue_filter",
    f"""WITH x AS (SELECT p_partkey, p_type, (['{"', '".join(SIZES)}'])[p_partkey % 5 + 1] AS size, (['{"', '".join(TIMES)}'])[(p_partkey // 5) % 4 + 1] AS time FROM part)
 SELECT * FROM x WHERE (regexp_matches(size, '(?i)< 1|MB') OR coalesce(try_cast(regexp_extract(size, '([0-9]+).*GB', 1) AS DOUBLE) <= 10, false))
 AND (regexp_matches(time, '(?i)min') OR coalesce(try_cast(regexp_extract(time, '([0-9]+).*hour', 1) AS DOUBLE) <= 6, false)) AND regexp_matches(p_type, '(?i)eco')""",
)
def p30(spark, d):
    def pick(values, i):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))

    x = table(spark, d, "part").select(
        "p_partkey", "p_type", pick(SIZES, F.col("p_partkey")).alias("size"), pick(TIMES, F.floor(F.col("p_partkey") / 5)).alias("time")
    )
    return x.filter(N.within_size(F.col("size"), 10) & N.within_hours(F.col("time"), 6) & F.col("p_type").rlike("(?i)eco"))


@query(
    "p31_array_stats",
    """SELECT vec_id, round(list_avg(e), 4) AS mean_intensity, round(list_stddev_pop(e), 4) AS std_intensity, round(list_max(e), 4) AS max_intensity
 FROM (SELECT vec_id, embedding::double[] AS e FROM embeddings)""",
    digits=4,
)
def p31(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", N.array_mean(e).alias("mean_intensity"), N.array_std(e).alias("std_intensity"), F.array_max(e).cast("double").alias("max_intensity")
    )


@query(
    "p31_shape_ratio",
    "SELECT p_partkey, round((p_size + 7) / (p_partkey % 13 + 5), 4) AS aspect_ratio, (p_size + 7) * (p_partkey % 13 + 5) AS image_area FROM part",
    digits=4,
)
def p31b(spark, d):
    w, h = F.col("p_size") + 7, F.col("p_partkey") % 13 + 5
    return table(spark, d, "part").select("p_partkey", (w / h).alias("aspect_ratio"), (w * h).cast("bigint").alias("image_area"))


@query("p32_row_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5000")
def p32(spark, d):
    """The optional row limit on read, here switched on (5000 rows by key)."""
    from cohortry.sources.readers import read_table

    return read_table(spark, f"{d}/orders.parquet", limit=5000, order_by=["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query(
    "p33_numeric_features",
    """SELECT l_linenumber, coalesce(l_quantity, 0) AS l_quantity, coalesce(l_extendedprice, 0) AS l_extendedprice,
 coalesce(CASE WHEN l_discount > 0.02 THEN l_discount END, 0) AS l_discount, l_tax FROM lineitem""",
)
def p33(spark, d):
    li = table(spark, d, "lineitem").withColumn("l_discount", F.when(F.col("l_discount") > 0.02, F.col("l_discount")))
    cols = N.numeric_columns(li, ["l_orderkey", "l_partkey", "l_suppkey"])
    return li.select(*cols).na.fill(0)


@query(
    "p34_overrides",
    """WITH x AS (SELECT o_orderkey, o_custkey % 5 AS target, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS cost FROM orders)
 SELECT o_orderkey, CASE WHEN target = 0 THEN 0 ELSE 1 END AS target, round(coalesce(cost, (SELECT quantile_cont(cost, 0.5) FROM x)), 6) AS cost FROM x""",
)
def p34(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 5).alias("target"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("cost"), "o_orderpriority",
    )
    return encode.apply_overrides(
        o, {"target_transform": "collapse", "impute": {"cost": "median"}, "drop": ["o_orderpriority"]}, "target"
    )
