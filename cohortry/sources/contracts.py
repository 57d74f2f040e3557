"""Dataset contracts: where a processed dataset lies and what it must hold."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cohortry.operators.quality import Validation, validate
from cohortry.operators.splits import split
from cohortry.sources.readers import read_table


@dataclass(frozen=True)
class DatasetContract:
    key: str
    path: str
    target: str | None
    modality: str
    required: tuple[str, ...] = ()
    id_column: str | None = None


# The processed datasets with their targets and required columns.
CONTRACTS = {
    c.key: c
    for c in [
        DatasetContract(
            "synthea_longitudinal", "synthea_longitudinal_processed.csv", "target", "temporal",
            ("patient_id", "target", "n_encounters", "n_conditions", "n_medications", "longitudinal_complexity_score",
             "dominant_condition_domain", "temporal_event_summary"), "patient_id",
        ),
        DatasetContract(
            "skin_cancer_imaging", "skin_cancer_imaging_processed.csv", "target", "metadata",
            ("image_path", "lesion_label", "lesion_icd10_code", "lesion_risk_category", "is_malignant", "target"), "image_path",
        ),
        DatasetContract(
            "medical_question_pairs", "medical_question_pairs_processed.csv", "is_duplicate", "text",
            ("question_primary", "question_secondary", "primary_concept_domain", "secondary_concept_domain",
             "concept_alignment", "has_ontology_match", "shared_concept_domain", "concept_pair_summary"), "pair_group_id",
        ),
        DatasetContract(
            "drug_reviews", "drug_reviews_processed.csv", "rating", "text",
            ("review_id", "drug_name", "condition", "effectiveness_score", "side_effect_severity", "drug_rxnorm_code",
             "condition_concept_domain", "rating"), "review_id",
        ),
    ]
}


def resolve(key: str, registry: dict[str, DatasetContract] | None = None) -> DatasetContract:
    try:
        return (registry or CONTRACTS)[key]
    except KeyError as exc:
        raise KeyError(f"unknown dataset {key!r}") from exc


@dataclass(frozen=True)
class LoadedDataset:
    contract: DatasetContract
    data: DataFrame
    validation: Validation | None


def load_dataset(
    spark: SparkSession, key: str, base_dir: str = ".", registry: dict[str, DatasetContract] | None = None,
    check: bool = True, additional_required: Iterable[str] = (), split_ids: Iterable[str] = (),
    test: float = 0.2, validation: float = 0.2, seed: int = 42,
) -> LoadedDataset:
    """Resolve, read, validate and (with `split_ids`) label the split, in one call."""
    c = resolve(key, registry)
    df = read_table(spark, f"{base_dir.rstrip('/')}/{c.path}")
    report = validate(df, tuple(dict.fromkeys((*c.required, *additional_required))), c.target) if check else None
    ids = list(split_ids)
    if ids and c.target and test > 0:
        df = split(df, ids, c.target, test, validation, seed)
    return LoadedDataset(c, df, report)
