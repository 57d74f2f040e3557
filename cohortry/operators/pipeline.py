"""A whole risk model as one object: raw frame in, predictions and explanations out.

Fitting splits the rows, fits the preprocessor on the training part alone, weighs or
oversamples, trains voting and stacking, keeps the better on the held-out part and a
background sample for explanations. It is stored as ml models and small tables.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.seeded import seeded_hash
from cohortry.operators import ensemble as V
from cohortry.operators import models as T
from cohortry.operators.explain import background_rows, contribution_rows, model_contributions
from cohortry.operators.preprocess import Preprocessor, assemble
from cohortry.operators.splits import split
from cohortry.session import checkpoint


@dataclass
class RiskPipeline:
    preprocessor: Preprocessor
    model: T.VotingEnsemble | T.StackingEnsemble
    chosen: str
    metrics: dict
    background: DataFrame

    @property
    def features(self) -> list[str]:
        return self.preprocessor.output_names

    def prepare(self, df: DataFrame) -> DataFrame:
        """Fitted columns, and the `features` vector of them."""
        return _vectors(self.preprocessor.transform(df), self.features)

    def predict(self, df: DataFrame) -> DataFrame:
        """The columns kept beside the features, with prediction and probability."""
        scored = self.model.predict_proba(self.prepare(df)) if self.chosen == "stacking" else self.model.predict(self.prepare(df))
        if "prediction" not in scored.columns:
            scored = scored.withColumn("prediction", T.label_of(self.model.classes, F.col("probability")))
        return scored.drop("features", *self.features)

    def explain(self, df: DataFrame, id_col: str, permutations: int | None = 20, seed: int = 42) -> DataFrame:
        """row_id, prediction, feature, value, contribution, rank: what each prepared feature
        adds to the probability of the predicted class, over the background."""
        rows = checkpoint(self.model.predict_proba(self.prepare(df)).withColumn("__class", V.argmax(F.col("probability"))).drop("features", "probability"))

        def score(d: DataFrame) -> DataFrame:
            return self.model.predict_proba(d.withColumn("features", array_to_vector("vec")), "score")

        phi = model_contributions(rows, id_col, self.features, background_rows(self.background, self.features), score, permutations, seed, len(self.model.classes))
        at = rows.join(phi, id_col).withColumn("prediction", F.get(F.array(*[F.lit(c) for c in self.model.classes]), F.col("__class")))
        return contribution_rows(at.withColumn("phi", F.get("phi", F.col("__class"))), id_col, self.features, F.col("phi"), ["prediction"])

    def save(self, spark: SparkSession, path: str) -> None:
        self.preprocessor.save(spark, f"{path}/preprocessor")
        T.save_ensemble(self.model, f"{path}/model", spark, self.features, self.metrics, self.background)
        spark.createDataFrame([(json.dumps({"chosen": self.chosen}),)], "spec string").coalesce(1).write.mode("overwrite").parquet(f"{path}/pipeline")

    @staticmethod
    def load(spark: SparkSession, path: str) -> RiskPipeline:
        model, spec = T.load_ensemble(f"{path}/model", spark)
        chosen = json.loads(spark.read.parquet(f"{path}/pipeline").first()["spec"])["chosen"]
        return RiskPipeline(Preprocessor.load(spark, f"{path}/preprocessor"), model, chosen, spec["metrics"], spark.read.parquet(f"{path}/model/background"))


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return assemble(df, features, "features").withColumn("features", array_to_vector("features"))


def fit_pipeline(
    df: DataFrame, label: str, id_cols: Sequence[str], members: Mapping[str, dict], preprocessor: Preprocessor | None = None, test: float = 0.2,
    folds: int = 5, seed: int = 42, imbalance_threshold: float = 3.0, oversample: bool = False, use_proba: bool = True, background: int = 100,
) -> RiskPipeline:
    """Fit everything on a raw frame with numbers, texts and nulls; the label may be a text.
    Rows without a label are left out. `background` is the size of the stored sample."""
    pre = preprocessor or Preprocessor()
    kept = [*id_cols, label, "split"]
    with T.persisted(split(df.filter(F.col(label).isNotNull()), id_cols, label, test, 0, seed)) as rows:
        pre.fit(rows.filter("split = 'train'"), kept)
        ready = checkpoint(_vectors(pre.transform(rows), pre.output_names))
    train, held = ready.filter("split = 'train'"), ready.filter("split = 'test'")
    got = T.fit_best(train, held, pre.output_names, label, id_cols, members, folds, seed, imbalance_threshold, oversample, use_proba)
    sample = train.orderBy(seeded_hash(f"background{seed}", *id_cols), *id_cols).limit(background)
    sample = checkpoint(sample.select(*[F.col(f"`{c}`") for c in pre.output_names]))
    return RiskPipeline(pre, got.model, got.chosen, got.metrics, sample)
