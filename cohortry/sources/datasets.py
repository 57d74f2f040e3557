"""Raw clinical datasets to clean feature tables, as compositions of the operators.

Each builder reads its raw files under a base folder and returns one lazy DataFrame.
`build_all` writes every dataset whose input exists, with a manifest beside them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.functions import clinical as C
from cohortry.functions import numeric as N
from cohortry.functions import text as T
from cohortry.operators import encode, longitudinal as L
from cohortry.operators.lookup import literal_table, lookup
from cohortry.operators.preprocess import fit_imputer
from cohortry.operators.quality import manifest
from cohortry.session import checkpoint
from cohortry.sources import readers
from cohortry.sources.sinks import write_table

# Columns of the headerless raw files.
HEART = ["age", "sex", "cp", "trestbps", "chol", "fbs", "restecg", "thalach", "exang", "oldpeak", "slope", "ca", "thal", "target"]
HEART_SITES = {"cleveland": "processed.cleveland.data", "hungarian": "processed.hungarian.data",
               "switzerland": "processed.switzerland.data", "va": "processed.va.data"}
BREAST_FEATURES = ["radius", "texture", "perimeter", "area", "smoothness", "compactness", "concavity", "concave_points",
                   "symmetry", "fractal_dimension"]
HEPATITIS = ["class", "age", "sex", "steroid", "antivirals", "fatigue", "malaise", "anorexia", "liver_big", "liver_firm",
             "spleen_palpable", "spiders", "ascites", "varices", "bilirubin", "alk_phosphate", "sgot", "albumin", "protime", "histology"]
THYROID = ["target", "t3_resin_uptake", "total_serum_thyroxin", "total_serum_triiodothyronine", "basal_tsh", "max_tsh_difference"]
DIABETES = ["patient_nbr", "admission_type_id", "discharge_disposition_id", "admission_source_id", "age_numeric", "gender_numeric",
            "race_numeric", "time_in_hospital", "num_lab_procedures", "num_procedures", "num_medications", "number_outpatient",
            "number_emergency", "number_inpatient", "number_diagnoses", "target"]
SYMPTOM_WORDS = ["fever", "cough", "fatigue", "shortness"]
REVIEW_NAMES = {"urlDrugName": "drug_name", "sideEffects": "side_effects", "benefitsReview": "benefits_review",
                "sideEffectsReview": "side_effects_review", "commentsReview": "comments_review"}
REVIEW_TEXTS = ["benefits_review", "side_effects_review", "comments_review"]


def numbered(df: DataFrame, out: str = "patient_id") -> DataFrame:
    """1..n in scan order.

    The frame is evaluated once, into the shared checkpoint folder: a second evaluation
    after a shuffle could give rows other positions. The high bits of a position are the
    partition, so a number is the rows of the partitions before plus the place inside;
    no row is sorted and the offsets are one row per partition."""
    pos = checkpoint(df.withColumn("__pos", F.monotonically_increasing_id()))
    pos = pos.withColumns({"__part": F.shiftright("__pos", 33), "__in": F.col("__pos").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over the partitions
    sizes = pos.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return pos.join(F.broadcast(offsets), "__part").withColumn(out, (F.col("__off") + F.col("__in") + 1).cast("bigint")).drop("__part", "__in", "__off", "__pos")


def fill_medians(df: DataFrame, exclude: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    return fit_imputer(df, N.numeric_columns(df, exclude), "median").transform(df)


def _doubles(names: list[str]) -> str:
    return ", ".join(f"`{n}` double" for n in names)


def heart(spark: SparkSession, base: str) -> DataFrame:
    df = readers.read_headerless(spark, f"{base}/heart+disease/processed.cleveland.data", _doubles(HEART))
    return fill_medians(numbered(df.withColumn("target", N.flag(F.col("target") > 0))), ("patient_id", "target"))


def heart_sites(spark: SparkSession, base: str) -> DataFrame:
    def one(file: str) -> DataFrame | None:
        path = f"{base}/heart+disease/{file}"
        if not readers.path_exists(spark, path):
            return None
        df = readers.read_headerless(spark, path, _doubles(HEART))
        return df.withColumn("target", N.flag(F.col("target") > 0))

    df = numbered(readers.union_sites({s: one(f) for s, f in HEART_SITES.items()}))
    df = encode.factorize(df, "site", "patient_id", "site_numeric")
    return fill_medians(df, ("patient_id", "target", "site_numeric"))


def breast(spark: SparkSession, base: str) -> DataFrame:
    names = [f"{f}_{s}" for s in ("mean", "se", "worst") for f in BREAST_FEATURES]
    df = readers.read_headerless(
        spark, f"{base}/breast+cancer+wisconsin+diagnostic/wdbc.data", "id bigint, diagnosis string, " + _doubles(names), ()
    )
    return df.select(F.col("id").alias("patient_id"), N.flag(F.col("diagnosis") == "M").alias("target"), *names)


def diabetes(spark: SparkSession, base: str) -> DataFrame:
    folder = f"{base}/diabetes+130-us+hospitals+for+years+1999-2008"
    df = readers.read_table(spark, f"{folder}/diabetic_data.csv").withColumns(
        {
            "age_numeric": C.value_map(F.col("age"), C.AGE_BANDS),
            "gender_numeric": N.flag(F.col("gender") == "Male"),
            "race_numeric": C.value_map(F.col("race"), C.RACE_CODES),
            "target": C.value_map(F.col("readmitted"), C.READMISSION),
        }
    )
    ids = ["admission_type_id", "discharge_disposition_id", "admission_source_id"]
    df = df.select(*DIABETES).withColumns({c: N.to_number(F.col(c)) for c in ids}).withColumnRenamed("patient_nbr", "patient_id")
    if readers.path_exists(spark, f"{folder}/IDS_mapping.csv"):
        codes = readers.read_sectioned_lookup(spark, f"{folder}/IDS_mapping.csv")
        for c in ids:
            side = codes.filter(F.trim("column") == c).select(F.col("code").cast("double").alias(c), F.col("description").alias(f"{c}_desc"))
            df = lookup(df, side, [c], {f"{c}_desc": F.lit("Unknown")})
    return fill_medians(df)


def hepatitis(spark: SparkSession, base: str) -> DataFrame:
    df = readers.read_headerless(spark, f"{base}/hepatitis/hepatitis.data", _doubles(HEPATITIS))
    df = numbered(df.withColumn("target", N.flag(F.col("class") == 2)).drop("class"))
    return fill_medians(df, ("patient_id", "target"))


def dermatology(spark: SparkSession, base: str) -> DataFrame:
    raw = readers.read_unnamed_parts(spark, [f"{base}/dermatology/dermatology.data"]).withColumnRenamed("target_raw", "target")
    df = raw.select(*[N.to_number(F.col(c)).alias(c) for c in raw.columns])
    return fill_medians(numbered(df.withColumn("target", (F.col("target") - 1).cast("int"))), ("patient_id", "target"))


def thyroid(spark: SparkSession, base: str) -> DataFrame:
    df = readers.read_headerless(spark, f"{base}/thyroid+disease/new-thyroid.data", _doubles(THYROID), ("?", "NA"))
    return fill_medians(numbered(df.withColumn("target", (F.col("target") - 1).cast("int"))), ("patient_id", "target"))


def appointments(spark: SparkSession, base: str) -> DataFrame:
    raw = readers.read_table(spark, f"{base}/Medical Appointments No-Show.csv")
    df = raw.toDF(*[n.replace("-", "_").lower() for n in raw.columns])
    if {"scheduledday", "appointmentday"} <= set(df.columns):
        days = N.days_between(F.col("scheduledday").cast("timestamp"), F.col("appointmentday").cast("timestamp"))
        df = df.withColumn("days_advance", days)
    if "gender" in df.columns:
        df = df.withColumn("gender_numeric", N.flag(F.col("gender") == "M"))
    for c in ("no_show", "noshow"):
        if c in df.columns:
            df = df.withColumn("target", N.flag(F.col(c) == "Yes"))
            break
    df = df.select(*N.numeric_columns(df))
    if "patient_id" not in df.columns:
        df = df.withColumn("patient_id", F.col("patientid")) if "patientid" in df.columns else numbered(df)
    return fill_medians(df)


def covid(spark: SparkSession, base: str) -> DataFrame:
    raw = readers.read_table(spark, f"{base}/covid_19_symptoms_survey.csv")
    df = numbered(raw.toDF(*[n.replace(" ", "_").lower() for n in raw.columns]))
    texts = N.string_columns(df, ["patient_id"])
    if texts:
        df = encode.encode_yes_no(df, texts, "patient_id")
    symptoms = [c for c in df.columns if any(w in c for w in SYMPTOM_WORDS)]
    named = [c for c in df.columns if "covid" in c or "positive" in c]
    if not symptoms and not named:
        raise ValueError("no symptom column and no named target; random labels are not made up")
    return fill_medians(df.withColumn("target", N.symptom_target(df, symptoms)), ("patient_id", "target"))


def _concepts(df: DataFrame, text: str, prefix: str) -> DataFrame:
    df = df.withColumn("__c", C.concept_index(text))
    return df.withColumns({f"{prefix}_{f}": C.concept_field(F.col("__c"), f) for f in ("code", "name", "domain")}).drop("__c")


def _lengths(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    out: dict[str, Column] = {}
    for prefix, c in columns.items():
        out[f"{prefix}_char_length"] = F.length(c)
        out[f"{prefix}_word_count"] = T.word_count(F.col(c))
    return df.withColumns(out)


def question_pairs(spark: SparkSession, base: str) -> DataFrame:
    raw = spark.read.schema("pair_group_id string, question_primary string, question_secondary string, is_duplicate string").option(
        "escape", '"'
    ).option("multiLine", "true").csv(f"{base}/medical_questions_pairs.csv")
    df = raw.select(
        F.coalesce(N.to_number(F.col("pair_group_id")), F.lit(-1.0)).cast("int").alias("pair_group_id"),
        T.clean(F.col("question_primary")).alias("question_primary"),
        T.clean(F.col("question_secondary")).alias("question_secondary"),
        F.coalesce(N.to_number(F.col("is_duplicate")), F.lit(0.0)).cast("int").alias("is_duplicate"),
    )
    df = df.withColumn("duplicate_label", C.value_map(F.col("is_duplicate"), {1: "duplicate", 0: "distinct"}))
    df = _lengths(df, {"primary": "question_primary", "secondary": "question_secondary"})
    df = df.withColumns(
        {
            "length_ratio": T.length_ratio(F.col("primary_char_length"), F.col("secondary_char_length")),
            "token_jaccard": T.token_jaccard(F.col("question_primary"), F.col("question_secondary")),
        }
    )
    df = _concepts(_concepts(df, "question_primary", "primary_concept"), "question_secondary", "secondary_concept")
    a, b, none = F.col("primary_concept_code"), F.col("secondary_concept_code"), C.NO_CONCEPT[1]
    same = a == b
    return df.withColumns(
        {
            "concept_alignment": N.flag(same),
            "has_ontology_match": N.flag((a != none) | (b != none)),
            "shared_concept_domain": F.when(same, F.col("primary_concept_domain")).otherwise("Mixed/Unaligned"),
            "concept_pair_summary": F.concat(F.initcap("primary_concept_domain"), F.lit(" ↔ "), F.initcap("secondary_concept_domain")),
        }
    )


def drug_reviews(spark: SparkSession, base: str) -> DataFrame:
    folder = f"{base}/drug+review+dataset+druglib"
    schema = "review_id string, urlDrugName string, rating string, effectiveness string, sideEffects string, condition string, benefitsReview string, sideEffectsReview string, commentsReview string"
    files = {"train": "drugLibTrain_raw.tsv", "test": "drugLibTest_raw.tsv"}
    paths = {s: f"{folder}/{f}" for s, f in files.items() if readers.path_exists(spark, f"{folder}/{f}")}
    df = readers.read_splits(spark, paths, schema).withColumnsRenamed(REVIEW_NAMES)
    rating = N.to_number(F.col("rating"))
    df = df.withColumns({**{c: T.clean(F.col(c)) for c in REVIEW_TEXTS}, "rating": rating}).filter(F.col("rating").isNotNull())
    df = df.withColumns(
        {
            "rating": F.col("rating").cast("int"),
            "effectiveness_score": C.value_map(F.col("effectiveness"), C.EFFECTIVENESS),
            "side_effect_severity": C.value_map(F.col("side_effects"), C.SIDE_EFFECTS),
            "drug_name": T.clean(F.coalesce("drug_name", F.lit("Unknown"))),
            "condition": T.clean(F.coalesce("condition", F.lit("Unknown"))),
        }
    )
    df = _lengths(df, {c.replace("_review", ""): c for c in REVIEW_TEXTS})
    words = sum((F.col(c.replace("_review", "") + "_word_count") for c in REVIEW_TEXTS), F.lit(0))
    df = df.withColumns(
        {
            "total_review_word_count": words,
            "net_rating_vs_side_effects": F.col("rating") - N.zero(F.col("side_effect_severity")),
            "drug_rxnorm_code": C.value_map(F.lower("drug_name"), C.DRUG_CODES, F.lit(C.UNKNOWN_DRUG)),
            "effectiveness_minus_side_effects": N.zero(F.col("effectiveness_score")) - N.zero(F.col("side_effect_severity")),
        }
    )
    df = _concepts(df, "condition", "condition_concept")
    return df.withColumn("condition_has_ontology_match", N.flag(F.col("condition_concept_code") != C.NO_CONCEPT[1]))


def lesion_images(spark: SparkSession, base: str) -> DataFrame:
    """Image metadata from the folder tree; pixels are not read."""
    df = readers.scan_labelled_files(spark, f"{base}/isic_skin_cancer_sample")
    codes = literal_table(spark, [(k, *v) for k, v in C.LESION_CODES.items()], "__label string, lesion_icd10_code string, lesion_risk_category string")
    df = lookup(
        df.withColumn("__label", F.lower("lesion_label")), codes, ["__label"],
        {"lesion_icd10_code": F.lit("UNKNOWN"), "lesion_risk_category": F.lit("unknown")},
    ).drop("__label")
    bad = N.flag(F.col("lesion_risk_category") == "malignant")
    df = df.withColumns({"is_malignant": bad, "target": bad, "concept_domain": F.lit("Dermatology")})
    order = numbered(df, "__n")
    return encode.factorize(order, "lesion_label", "__n", "lesion_class_index").drop("__n")


EHR_TABLES = ["patients", "encounters", "conditions", "medications", "observations", "procedures", "careplans", "immunizations"]


def longitudinal(spark: SparkSession, base: str, as_of: str = "2024-01-01") -> DataFrame:
    """Eight EHR tables to one row per patient. Ages of patients without encounters
    count at `as_of`."""
    t = {n: readers.read_table(spark, f"{base}/Synthea Synthetic/{n}.csv") for n in EHR_TABLES}
    ts = lambda c: F.col(c).cast("timestamp")
    pid = F.col("PATIENT").alias("patient")
    enc = t["encounters"].select(pid, ts("START").alias("start"), ts("STOP").alias("stop"), F.col("ENCOUNTERCLASS").alias("class"))

    def coded(name: str) -> DataFrame:
        return t[name].select(pid, ts("START").alias("start"), ts("STOP").alias("stop"), F.col("CODE").alias("code"), F.col("DESCRIPTION").alias("description"))

    def dated(name: str, date: str) -> DataFrame:
        return t[name].select(pid, ts(date).alias("date"), F.col("DESCRIPTION").alias("label"))

    cond, med = coded("conditions"), coded("medications")
    obs = t["observations"].select(
        pid, F.col("CODE").alias("code"), ts("DATE").alias("ts"), F.col("VALUE").cast("string").alias("value"), N.to_number(F.col("VALUE")).alias("id")
    )
    kind = L.EventKind
    events = L.timeline(
        [
            (enc, [kind("encounter", "start", "class")]), (cond, [kind("condition", "start", "description")]),
            (med, [kind("medication", "start", "description")]), (dated("procedures", "DATE"), [kind("procedure", "date", "label")]),
            (dated("careplans", "START"), [kind("careplan", "date", "label")]),
            (dated("immunizations", "DATE"), [kind("immunization", "date", "label")]),
        ]
    )
    order = ["start", "description"]
    parts = [
        L.encounter_features(enc),
        L.code_features(cond, [L.CodeCounts("n_conditions", "n_unique_condition_codes", "n_chronic_conditions")]),
        L.code_features(med, [L.CodeCounts("n_medications", "n_unique_medication_codes", "n_active_medications")]),
        L.summary_list(cond, "description", order, "condition_summary"),
        L.summary_list(med, "description", order, "medication_summary"),
        L.dominant_domain(cond, "description"),
        L.observation_features(obs, C.OBSERVATION_CODES),
        events.groupBy("patient").agg(F.count(F.lit(1)).alias("temporal_event_count")),
        L.event_summary(events),
    ]
    p = t["patients"].select(
        F.col("Id").alias("patient"), F.col("BIRTHDATE").cast("date").alias("birthdate"), F.col("DEATHDATE").cast("date").alias("deathdate"),
        "RACE", "ETHNICITY", "GENDER", "ZIP", "CITY", "STATE", "MARITAL",
    )
    df = L.add_outcomes(L.attach(p, parts))
    df = df.withColumns(
        {
            "condition_summary": F.coalesce("condition_summary", F.lit("")),
            "medication_summary": F.coalesce("medication_summary", F.lit("")),
            "dominant_condition_domain": F.coalesce("dominant_condition_domain", F.lit(C.NO_CONCEPT[0])),
            "numeric_observation_count": N.zero(F.col("numeric_observation_count")),
            "temporal_event_count": N.zero(F.col("temporal_event_count")),
            "temporal_event_summary": F.coalesce("temporal_event_summary", F.lit("[]")),
            "age_at_last_encounter_years": N.age_years(F.col("birthdate"), F.col("last_encounter_end"), F.lit(as_of).cast("timestamp")),
            "has_death_date": N.flag(F.col("deathdate").isNotNull()),
            "gender_code": C.binary_code(F.col("GENDER")),
            "RACE": F.coalesce("RACE", F.lit("Unknown")),
            "ETHNICITY": F.coalesce("ETHNICITY", F.lit("Unknown")),
        }
    )
    df = numbered(df, "__n")
    for c in ("RACE", "ETHNICITY"):
        df = encode.factorize(df, c, "__n", f"{c.lower()}_code")
    return df.drop("__n").withColumnRenamed("patient", "patient_id")


@dataclass(frozen=True)
class Dataset:
    build: Callable[[SparkSession, str], DataFrame]
    raw: str
    target: str
    description: str


DATASETS = {
    "heart_disease_uci": Dataset(heart, "heart+disease/processed.cleveland.data", "target", "Heart disease, one site"),
    "heart_disease_multicenter": Dataset(heart_sites, "heart+disease", "target", "Heart disease, four sites"),
    "breast_cancer_wisconsin": Dataset(breast, "breast+cancer+wisconsin+diagnostic/wdbc.data", "target", "Breast cancer diagnostics"),
    "diabetes_130_hospitals": Dataset(diabetes, "diabetes+130-us+hospitals+for+years+1999-2008/diabetic_data.csv", "target", "Diabetes readmissions"),
    "hepatitis": Dataset(hepatitis, "hepatitis/hepatitis.data", "target", "Hepatitis survival"),
    "dermatology": Dataset(dermatology, "dermatology/dermatology.data", "target", "Dermatology classes"),
    "medical_appointments": Dataset(appointments, "Medical Appointments No-Show.csv", "target", "Missed appointments"),
    "covid_symptoms": Dataset(covid, "covid_19_symptoms_survey.csv", "target", "Symptom survey"),
    "thyroid_disease": Dataset(thyroid, "thyroid+disease/new-thyroid.data", "target", "Thyroid classes"),
    "synthea_longitudinal": Dataset(longitudinal, "Synthea Synthetic/patients.csv", "target", "Longitudinal patients"),
    "medical_question_pairs": Dataset(question_pairs, "medical_questions_pairs.csv", "is_duplicate", "Question pairs"),
    "drug_reviews": Dataset(drug_reviews, "drug+review+dataset+druglib", "rating", "Drug reviews"),
    "skin_cancer_imaging": Dataset(lesion_images, "isic_skin_cancer_sample", "target", "Lesion image metadata"),
}


def build_all(spark: SparkSession, base: str, out: str, fmt: str = "parquet") -> DataFrame:
    """Write every dataset whose input exists; the manifest is computed from the
    written tables, saved as JSON beside them and returned."""
    done = {}
    for name, ds in DATASETS.items():
        if readers.path_exists(spark, f"{base}/{ds.raw}"):
            path = write_table(ds.build(spark, base), f"{out}/{name}_processed.{fmt}", fmt)
            done[name] = (readers.read_table(spark, path), {"target": ds.target, "type": "classification", "description": ds.description})
    if not done:
        raise FileNotFoundError(f"no raw dataset under {base}")
    summary = manifest(done)
    write_table(summary, f"{out}/dataset_summary", "json")
    return summary
