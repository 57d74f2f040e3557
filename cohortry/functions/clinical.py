"""Clinical vocabularies and value maps, and the column expressions over them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered concepts (domain, code, name, keywords). The first concept
# with a keyword contained in the lower-cased text wins.
CONCEPTS = [
    ("Cardiology", "SNOMEDCT:49872002", "Disorder of cardiovascular system",
     ["cardio", "heart", "angina", "myocard", "cholesterol", "blood pressure",
      "hypertension", "tachycardia", "arrythmia"]),
    ("Endocrinology", "SNOMEDCT:237602007", "Endocrine system disorder",
     ["diabet", "glucose", "insulin", "thyroid", "hormone", "metabolic"]),
    ("Dermatology", "SNOMEDCT:23853001", "Disorder of skin",
     ["skin", "lesion", "rash", "derm", "acne", "melanoma", "keratosis"]),
    ("Infectious disease", "SNOMEDCT:40733004", "Communicable disease",
     ["infection", "covid", "virus", "flu", "pneumonia", "antibiotic"]),
    ("Respiratory", "SNOMEDCT:50043002", "Disorder of respiratory system",
     ["asthma", "breath", "respir", "lung", "bronch"]),
    ("Neurology", "SNOMEDCT:118940003", "Disorder of nervous system",
     ["neuro", "brain", "stroke", "seizure", "dementia", "headache"]),
    ("Mental health", "SNOMEDCT:74732009", "Mental disorder",
     ["depress", "anxiety", "mental", "stress", "psych", "bipolar"]),
    ("Gastroenterology", "SNOMEDCT:118171006", "Disorder of digestive system",
     ["gastro", "stomach", "bowel", "abdomen", "reflux", "colon"]),
    ("Musculoskeletal", "SNOMEDCT:928000", "Disorder of musculoskeletal system",
     ["bone", "joint", "muscle", "arthritis", "back pain"]),
]
# The concept of a text without any match.
NO_CONCEPT = ("General", "SNOMEDCT:000000", "Unknown concept")
# Drug name to RXNORM code.
DRUG_CODES = {
    "atorvastatin": "RXNORM:83367", "metformin": "RXNORM:860975",
    "lisinopril": "RXNORM:29046", "omeprazole": "RXNORM:9678",
    "ibuprofen": "RXNORM:5640", "levothyroxine": "RXNORM:966249",
    "insulin": "RXNORM:847232", "amoxicillin": "RXNORM:723",
    "sertraline": "RXNORM:865098", "acetaminophen": "RXNORM:161",
}
UNKNOWN_DRUG = "RXNORM:UNKNOWN"
# Lesion label to ICD-10 code and risk category.
LESION_CODES = {
    "actinic keratosis": ("L57.0", "premalignant"),
    "basal cell carcinoma": ("C44.91", "malignant"),
    "dermatofibroma": ("D23.5", "benign"),
    "melanoma": ("C43.9", "malignant"),
    "nevus": ("D22.9", "benign"),
    "pigmented benign keratosis": ("L82.1", "benign"),
    "seborrheic keratosis": ("L82.1", "benign"),
    "squamous cell carcinoma": ("C44.92", "malignant"),
    "vascular lesion": ("I78.1", "benign"),
}
# Ordinal and categorical value maps; anything else becomes null.
AGE_BANDS = {f"[{lo}-{lo + 10})": lo + 5 for lo in range(0, 100, 10)}
RACE_CODES = {"Caucasian": 0, "AfricanAmerican": 1, "Hispanic": 2, "Other": 3, "Asian": 4, "?": 5}
READMISSION = {"NO": 0, "<30": 1, ">30": 1}
EFFECTIVENESS = {
    "Highly Effective": 5, "Considerably Effective": 4, "Moderately Effective": 3,
    "Marginally Effective": 2, "Ineffective": 1,
}
SIDE_EFFECTS = {
    "No Side Effects": 1, "Mild Side Effects": 2, "Moderate Side Effects": 3,
    "Severe Side Effects": 4, "Extremely Severe Side Effects": 5,
}
# Observation codes of the longitudinal table.
OBSERVATION_CODES = {
    "8480-6": "systolic_bp", "8462-4": "diastolic_bp", "2085-9": "hdl_cholesterol",
    "2089-1": "ldl_cholesterol", "2345-7": "glucose",
}


def value_map(col: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Literal map lookup; unmapped values become null or `default`."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), col)
    return found if default is None else F.coalesce(found, default)


def concept_index(text: str) -> Column:
    """0-based index of the first matching concept; len(CONCEPTS) when none does.

    `text` is a SQL expression: one parsed CASE keeps plan building cheap."""
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN {i}"
        for i, (_, _, _, words) in enumerate(CONCEPTS)
    )
    return F.expr(f"CASE {arms} ELSE {len(CONCEPTS)} END")


def concept_field(index: Column, field: str) -> Column:
    """`domain`, `code` or `name` of a concept index."""
    pos = {"domain": 0, "code": 1, "name": 2}[field]
    values = ", ".join(f"'{c[pos]}'" for c in [*CONCEPTS, NO_CONCEPT])
    return F.get(F.expr(f"array({values})"), index)


def binary_code(col: Column, positive: Mapping | None = None, none_of: str = "Unknown") -> Column:
    """Upper-cased lookup with 0 for anything else (gender codes)."""
    return value_map(F.upper(F.coalesce(col, F.lit(none_of))), positive or {"M": 1, "F": 0}, F.lit(0))


def label_pattern(col: Column) -> Column:
    """Group laboratory labels by the pattern they contain."""
    low = F.lower(col.cast("string"))
    return (
        F.when(low.contains("hyper"), F.lit("hyper"))
        .when(low.contains("hypo"), F.lit("hypo"))
        .when(low.contains("negative") | low.contains("normal"), F.lit("normal"))
        .otherwise(low)
    )
