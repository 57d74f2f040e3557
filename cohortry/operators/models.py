"""Training, ensembles and scoring on `pyspark.ml`.

A fitted learner maps a DataFrame with a `features` vector to class probabilities in
an array ordered by class label. Training data is persisted while it is used.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.numeric import bin_of
from cohortry.functions.seeded import seeded_hash  # noqa: F401  (public helper for callers)
from cohortry.operators import ensemble as V
from cohortry.operators import metrics as M
from cohortry.operators.balance import with_weights
from cohortry.operators.splits import kfold, split
from cohortry.session import checkpoint, scratch_dir

SHORT_TRACE = 32


def learner(name: str, n_classes: int = 2, weight: str | None = None, **params):
    """random_forest | gbt | logistic | linear_svm. Boosting and the margin learner are
    binary, so more classes go through one-vs-rest."""
    common = {"featuresCol": "features", "labelCol": "label_index"}
    if weight:
        common["weightCol"] = weight
    if name == "random_forest":
        return RandomForestClassifier(**common, **{"numTrees": 100, "maxDepth": 10, "seed": 42, **params})
    if name == "logistic":
        return LogisticRegression(**common, **{"maxIter": 100, **params})
    if name == "gbt":
        base = GBTClassifier(**common, **{"maxIter": 100, "maxDepth": 5, "seed": 42, **params})
    elif name == "linear_svm":
        base = LinearSVC(**common, **{"maxIter": 100, **params})
    else:
        raise ValueError(f"unknown learner {name!r}")
    if n_classes <= 2:
        return base
    return OneVsRest(classifier=base, **common)


def class_labels(df: DataFrame, label: str) -> list:
    """Sorted class labels; a label column holds few distinct values by contract."""
    rows = df.select(label).filter(F.col(label).isNotNull()).distinct().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10000 classes")
    return sorted(r[0] for r in rows)


def index_labels(df: DataFrame, label: str, classes: Sequence) -> DataFrame:
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label))
    return df.withColumn("label_index", (at - 1).cast("double")).filter(F.col("label_index") >= 0)


def vectorize(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where the input has fewer partitions (a few large files): a fit
    passes over its rows once a level or step."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


#: Rows a cell of binned features stands for, at least, where a forest is fitted on cells.
ROWS_A_CELL = 16


def split_points(values: np.ndarray, max_bins: int) -> list[float]:
    """Candidate thresholds of a feature as the trees of Spark choose them: between all
    distinct values where they fit the bins, else next to equal shares of the rows."""
    v, n = np.unique(values, return_counts=True)
    mids = (v[:-1] + v[1:]) / 2
    if len(mids) < max_bins:
        return mids.tolist()
    stride = n.sum() / max_bins
    out, before, goal = [], n[0], stride
    for i in range(1, len(v)):
        now = before + n[i]
        if abs(before - goal) < abs(now - goal):
            out.append(float(mids[i - 1]))
            goal += stride
        before = now
    return out


def fit_forest(df: DataFrame, id_col: str, features: Sequence[str], **params):
    """A random forest classifier of `learner` for `label_index`, on counted cells where rows
    crowd them.

    A tree sees of a row only its bins (at most maxBins a feature) and how often it was
    drawn: Poisson draws of the rows of a (bins, class) cell add up to one Poisson draw of
    their number, so every tree is fitted on cells weighted by its own draws, with feature
    subsets of its own seed. The work of a tree follows the cells, only counting them reads
    all rows. Where cells are not much fewer than rows, the rows themselves are fitted."""
    spark, label = df.sparkSession, "label_index"
    est = learner("random_forest", cacheNodeIds=True, **params)
    trees, bins, seed = est.getNumTrees(), est.getMaxBins(), est.getSeed()
    n = df.count()
    plain = trees > 1 and est.getBootstrap() and not est.isDefined("weightCol") and est.getFeatureSubsetStrategy() == "auto"
    if plain and n >= 4 * ROWS_A_CELL * bins:
        share = min(1.0, max(bins * bins, 10_000) / n)  # rows that Spark looks at for thresholds
        picked = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 31)) < F.lit(share * (1 << 31))  # whatever the partitions
        sample = df.filter(picked).select(*[F.col(f"`{f}`").cast("double").alias(f) for f in features]).toPandas()
        cuts = [split_points(sample[f].dropna().to_numpy(), bins) for f in features]
        binned = [F.when(F.col(f"`{f}`").isNotNull() & ~F.isnan(f"`{f}`"), bin_of(F.col(f"`{f}`").cast("double"), c)).alias(f"b{i}") for i, (f, c) in enumerate(zip(features, cuts))]
        cells = df.select(F.col(label).cast("double").alias(label), *binned).groupBy(label, *[f"b{i}" for i in range(len(features))]).agg(F.count(F.lit(1)).alias("n"))
        cells = checkpoint(cells)
        found = cells.count()
        if ROWS_A_CELL * found <= n:
            return _forest_of_cells(spark, cells, found, cuts, label, trees, seed, est.getSubsamplingRate(), params)
    rows = df.select(id_col, label, *[f"`{f}`" for f in features])
    return est.fit(VectorAssembler(inputCols=list(features), outputCol="features").transform(spread(rows, id_col)))


def _forest_of_cells(spark: SparkSession, cells: DataFrame, found: int, cuts: Sequence[Sequence[float]], label: str, trees: int, seed: int, rate: float, params: Mapping):
    names, draws = [f"b{i}" for i in range(len(cuts))], [f"drawn{t}" for t in range(trees)]
    seeds = [int(s) for s in np.random.SeedSequence(seed & ((1 << 64) - 1)).generate_state(trees)]
    classes = int(cells.agg(F.max(label)).first()[0] or 0) + 1

    def draw(batches):
        for b in batches:
            drawn = [np.random.default_rng(int(h) & ((1 << 64) - 1)).poisson(n * rate, trees) for h, n in zip(b["h"], b["n"])]
            drawn = pd.DataFrame(np.array(drawn).reshape(len(b), trees), columns=draws, index=b.index)
            yield pd.concat([b.drop(columns=["h", "n"]), drawn], axis=1)

    schema = ",".join([f"{label} double", *[f"{c} int" for c in names], *[f"{c} bigint" for c in draws]])
    keyed = cells.select(label, *names, "n", F.xxhash64(F.lit(seed), label, *names).alias("h"))
    keyed = keyed.repartition(_parts(found), *names).sortWithinPartitions(label, *names)
    drawn = VectorAssembler(inputCols=names, outputCol="features").transform(keyed.mapInPandas(draw, schema))
    # classes that a draw leaves out are still classes
    known = {"ml_attr": {"type": "nominal", "name": label, "num_vals": max(classes, 2)}}

    with persisted(drawn.select("features", F.col(label).alias(label, metadata=known), *draws)) as rows:
        rows.count()

        def fit(t: int):
            one = {**params, "numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "sqrt", "seed": seeds[t]}
            some = rows.select("features", label, F.col(draws[t]).cast("double").alias("weight")).filter("weight > 0")
            return learner("random_forest", weight="weight", **one).fit(some)

        with ThreadPool(min(trees, max(1, spark.sparkContext.defaultParallelism))) as pool:
            fitted = pool.map(inheritable_thread_target(spark)(fit), range(trees))
    return _joined(spark, fitted, cuts)


def _parts(cells: int) -> int:
    return max(1, -(-cells // 65_536))


def _joined(spark: SparkSession, fitted: Sequence, cuts: Sequence[Sequence[float]]):
    """One forest of single trees that were fitted on bins, with the thresholds of the bins."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    package = jvm.org.apache.spark.ml.classification
    single = [m._java_obj.trees()[0] for m in fitted]
    array = gateway.new_array(package.DecisionTreeClassificationModel, len(single))
    for i, t in enumerate(single):
        array[i] = t
    first = fitted[0]
    whole = package.RandomForestClassificationModel(first.uid, array, len(cuts), first.numClasses)
    of_all = jvm.org.apache.spark.ml.param.ParamMap.empty()
    for name, value in (("numTrees", len(single)), ("bootstrap", True), ("featureSubsetStrategy", "auto")):
        of_all.put(whole.getParam(name), value)
    from_, to = scratch_dir(spark, "bins-"), scratch_dir(spark, "forest-")
    first._java_obj.copyValues(whole, of_all).write().save(from_)
    spark.read.text(f"{from_}/metadata").coalesce(1).write.text(f"{to}/metadata")
    spark.read.parquet(f"{from_}/treesMetadata").write.parquet(f"{to}/treesMetadata")
    nodes = spark.read.parquet(f"{from_}/data")
    ends = F.array(*[F.array(*[F.lit(float(c)) for c in cut]).cast("array<double>") for cut in cuts])
    split = F.col("nodeData.split")
    at = F.floor(split["leftCategoriesOrThreshold"][0]).cast("int")
    threshold = F.when(split["featureIndex"] >= 0, F.array(F.get(F.get(ends, split["featureIndex"]), at))).otherwise(split["leftCategoriesOrThreshold"])
    mapped = F.col("nodeData").withField("split", split.withField("leftCategoriesOrThreshold", threshold))
    nodes.withColumn("nodeData", mapped).write.parquet(f"{to}/data")
    return RandomForestClassificationModel.load(to)


@contextmanager
def persisted(df: DataFrame):
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def _one_proba(model, df: DataFrame, out: str) -> DataFrame:
    """Adds the probability array of a fitted model."""
    for c in ("rawPrediction", "probability", "prediction"):
        df = df.drop(c)
    if hasattr(model, "models"):  # one-vs-rest: positive scores of the parts, normalized
        parts = []
        for i, m in enumerate(model.models):
            df = _one_proba(m, df, f"__part{i}")
            parts.append(F.col(f"__part{i}")[1])
        total = reduce(lambda a, b: a + b, parts)
        k = F.lit(1.0 / len(parts))
        probs = F.array(*[F.when(total > 0, p / total).otherwise(k) for p in parts])
        return df.withColumn(out, probs).drop(*[f"__part{i}" for i in range(len(model.models))])
    got = model.transform(df)
    if "probability" in got.columns:
        rest = ["rawPrediction", "prediction"] + ([] if out == "probability" else ["probability"])
        return got.withColumn(out, vector_to_array("probability")).drop(*rest)
    margin = vector_to_array("rawPrediction")[1]
    return got.withColumn(out, V.margin_probabilities(margin)).drop("rawPrediction", "prediction")


@dataclass
class FittedModel:
    name: str
    model: object
    classes: list

    def predict_proba(self, df: DataFrame, out: str = "probability") -> DataFrame:
        return _one_proba(self.model, df, out)


def fit_model(name: str, train: DataFrame, label: str, weight: str | None = None, classes: Sequence | None = None, **params) -> FittedModel:
    """train holds `features` and the label column."""
    classes = list(classes or class_labels(train, label))
    if len(classes) < 2:
        raise ValueError("training needs two classes or more")
    data = index_labels(train, label, classes)
    return FittedModel(name, learner(name, len(classes), weight, **params).fit(data), classes)


def label_of(classes: Sequence, p: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in classes]), V.argmax(p))


@dataclass
class VotingEnsemble:
    """Soft (weighted mean of probabilities) or hard (majority) voting."""

    members: Mapping[str, dict]
    kind: str = "soft"
    weights: Mapping[str, float] | None = None
    fitted: dict = field(default_factory=dict)
    classes: list = field(default_factory=list)

    def __post_init__(self):
        V.check_voting(self.kind)

    def fit(self, train: DataFrame, label: str, weight: str | None = None) -> "VotingEnsemble":
        self.classes = class_labels(train, label)
        self.fitted = {n: fit_model(p.get("learner", n), train, label, weight, self.classes, **{k: v for k, v in p.items() if k != "learner"}) for n, p in self.members.items()}
        return self

    def _scores(self, df: DataFrame) -> DataFrame:
        for n, m in self.fitted.items():
            df = m.predict_proba(df, f"__p_{n}")
        return df

    def predict_proba(self, df: DataFrame, out: str = "probability") -> DataFrame:
        names = list(self.fitted)
        w = [float((self.weights or {}).get(n, 1.0)) for n in names]
        scored = self._scores(df)
        return scored.withColumn(out, V.soft_vote([F.col(f"__p_{n}") for n in names], w)).drop(*[f"__p_{n}" for n in names])

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self.kind == "soft":
            return self.predict_proba(df).withColumn(out, label_of(self.classes, F.col("probability")))
        names = list(self.fitted)
        votes = [label_of(self.classes, F.col(f"__p_{n}")) for n in names]
        return self._scores(df).withColumn(out, V.hard_vote(votes)).drop(*[f"__p_{n}" for n in names])

    def importance(self, features: Sequence[str]) -> list[tuple[str, str, float]]:
        """(model, feature, importance) of members that have importances or coefficients."""
        out = []
        for n, m in self.fitted.items():
            out += [(n, f, v) for f, v in zip(features, model_importance(m.model, len(features)))]
        return out


def model_importance(model, d: int) -> list[float]:
    """Importances, or mean |coef| over classes; empty for other models."""
    if hasattr(model, "models"):
        parts = [model_importance(m, d) for m in model.models]
        return [sum(p[j] for p in parts) / len(parts) for j in range(d)]
    if hasattr(model, "featureImportances"):
        return [float(x) for x in model.featureImportances.toArray()]
    if hasattr(model, "coefficientMatrix"):
        c = model.coefficientMatrix.toArray()
        return [float(abs(c[:, j]).mean()) for j in range(d)]
    if hasattr(model, "coefficients"):
        return [abs(float(x)) for x in model.coefficients.toArray()]
    return []


@dataclass
class StackingEnsemble:
    """Out-of-fold base probabilities (or predicted classes, without `use_proba`) train a
    logistic meta learner; the bases are then refitted on all rows. Classes stay aligned on
    the index over all folds."""

    members: Mapping[str, dict]
    folds: int = 5
    seed: int = 42
    meta: str = "logistic"
    use_proba: bool = True
    fitted: dict = field(default_factory=dict)
    meta_model: FittedModel | None = None
    classes: list = field(default_factory=list)

    def _meta_features(self, df: DataFrame, models: Mapping[str, FittedModel]) -> DataFrame:
        for n, m in models.items():
            df = m.predict_proba(df, f"__p_{n}")
        outputs = [F.col(f"__p_{n}") for n in models]
        flat = F.flatten(F.array(*outputs)) if self.use_proba else F.array(*[V.argmax(p).cast("double") for p in outputs])
        return df.withColumn("__meta", array_to_vector(flat)).drop(*[f"__p_{n}" for n in models])

    def _fit_bases(self, train, label, weight):
        return {
            n: fit_model(p.get("learner", n), train, label, weight, self.classes, **{k: v for k, v in p.items() if k != "learner"})
            for n, p in self.members.items()
        }

    def fit(
        self, train: DataFrame, label: str, id_cols: Sequence[str], weight: str | None = None, fitted: Mapping[str, FittedModel] | None = None
    ) -> "StackingEnsemble":
        """`fitted`: the members where they are already fitted on all of these rows, as a
        voting ensemble of the same members holds them; else they are fitted here."""
        if fitted is not None and set(fitted) != set(self.members):
            raise ValueError("fitted models must be those of the members")
        kept = dict.fromkeys([*id_cols, label, "features", *([weight] if weight else [])])
        train = train.select(*kept)
        self.classes = class_labels(train, label) if fitted is None else list(next(iter(fitted.values())).classes)
        folded = kfold(train, id_cols, self.folds, self.seed, "__fold")
        with persisted(folded) as data:
            parts = []
            for k in range(self.folds):
                models = self._fit_bases(data.filter(F.col("__fold") != k), label, weight)
                parts.append(self._meta_features(data.filter(F.col("__fold") == k), models).select("__meta", label))
            oof = reduce(lambda a, b: a.unionByName(b), parts).withColumnRenamed("__meta", "features")
            with persisted(oof) as rows:
                self.meta_model = fit_model(self.meta, rows, label, None, self.classes)
            self.fitted = self._fit_bases(data, label, weight) if fitted is None else {n: fitted[n] for n in self.members}
        return self

    def predict_proba(self, df: DataFrame, out: str = "probability") -> DataFrame:
        m = self._meta_features(df, self.fitted).withColumnRenamed("features", "__base").withColumnRenamed("__meta", "features")
        return self.meta_model.predict_proba(m, out).drop("features").withColumnRenamed("__base", "features")

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.predict_proba(df).withColumn(out, label_of(self.classes, F.col("probability")))


# ------------------------------------------------------------------ evaluation
def evaluate_model(model, df: DataFrame, label: str) -> dict[str, float]:
    """Weighted scores; for two classes also AUC, average precision, Brier and log loss."""
    scored = model.predict_proba(df)
    pred = scored.withColumn("__pred", label_of(model.classes, F.col("probability")))
    with persisted(pred.select(label, "__pred", "probability")) as rows:
        s = M.summary_scores(rows, label, "__pred").first().asDict()  # one row
        out = {k: float(s[k]) for k in ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted")}
        out["roc_auc"] = 0.0
        if len(model.classes) == 2:
            b = rows.select((F.col(label) == F.lit(model.classes[1])).cast("int").alias("y"), F.col("probability")[1].alias("p"))
            r = M.ranking_scores(b, "y", "p").first()
            q = M.probability_scores(b, "y", "p").first()
            out |= {
                "roc_auc": float(r["roc_auc"] or 0.0), "pr_auc": float(r["pr_auc"] or 0.0),
                "brier_score": float(q["brier_score"]), "log_loss": float(q["log_loss"]),
            }
    return out


def cross_validate(name: str, df: DataFrame, label: str, id_cols: Sequence[str], folds: int = 5, seed: int = 42, **params) -> dict[str, float]:
    """Mean and population deviation of the fold AUCs (accuracy beyond two classes)."""
    classes = class_labels(df, label)
    metric = "roc_auc" if len(classes) == 2 else "accuracy"
    scores = []
    with persisted(kfold(df, id_cols, folds, seed, "__fold")) as data:
        for k in range(folds):
            m = fit_model(name, data.filter(F.col("__fold") != k), label, None, classes, **params)
            scores.append(evaluate_model(m, data.filter(F.col("__fold") == k), label)[metric])
    mean = sum(scores) / folds
    return {"cv_mean": mean, "cv_std": (sum((s - mean) ** 2 for s in scores) / folds) ** 0.5}


def grid_search(name: str, df: DataFrame, label: str, grid: Mapping[str, Sequence], id_cols: Sequence[str], folds: int = 5, parallelism: int = 4, seed: int = 42):
    """Best parameters by mean fold AUC: (params, score, all results)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    classes = class_labels(df, label)
    est = learner(name, len(classes))
    builder = ParamGridBuilder()
    for p, values in grid.items():
        builder = builder.addGrid(est.getParam(p), list(values))
    combos = builder.build()
    ev = BinaryClassificationEvaluator(labelCol="label_index", metricName="areaUnderROC", numBins=0)
    data = index_labels(kfold(df, id_cols, folds, seed, "fold"), label, classes)
    cv = CrossValidator(estimator=est, estimatorParamMaps=combos, evaluator=ev, numFolds=folds, foldCol="fold", parallelism=parallelism)
    with persisted(data) as rows:
        got = cv.fit(rows)
    results = [({p.name: v for p, v in c.items()}, s) for c, s in zip(combos, got.avgMetrics)]
    best = max(range(len(results)), key=lambda i: results[i][1])
    return results[best][0], results[best][1], results


def choose_model(voting: dict[str, float], stacking: dict[str, float], n_classes: int) -> str:
    """Stacking only when strictly better: by AUC, or by weighted F1 beyond two classes."""
    key = "roc_auc" if n_classes == 2 else "f1_weighted"
    return "stacking" if stacking.get(key, 0.0) > voting.get(key, 0.0) else "voting"


def threshold_members(results: Mapping[str, Mapping[str, float]], at_least: float = 0.7) -> list[str]:
    """Members whose AUC met the threshold; an ensemble needs two."""
    return [n for n, r in results.items() if r.get("roc_auc", 0.0) >= at_least]


def threshold_ensemble(members: Mapping[str, dict], train: DataFrame, test: DataFrame, label: str, at_least: float = 0.7):
    """Voting ensemble over the members that meet the threshold, or None below two."""
    base = VotingEnsemble(members).fit(train, label)
    results = {n: evaluate_model(m, test, label) for n, m in base.fitted.items()}
    keep = threshold_members(results, at_least)
    if len(keep) < 2:
        return None, results
    base.fitted = {n: base.fitted[n] for n in keep}
    base.members = {n: members[n] for n in keep}
    return base, results


@dataclass
class TrainingOutcome:
    chosen: str
    model: object
    metrics: dict
    classes: list
    features: list


def train_best(df: DataFrame, features: Sequence[str], label: str, id_cols: Sequence[str], members: Mapping[str, dict], test: float = 0.2, folds: int = 5, seed: int = 42, imbalance_threshold: float = 3.0, oversample: bool = False, use_proba: bool = True) -> TrainingOutcome:
    """Split, weigh or oversample, fit voting and stacking, validate, keep the better."""
    data = split(df, id_cols, label, test, 0, seed)
    with persisted(vectorize(data, features)) as rows:
        train, held = rows.filter("split = 'train'"), rows.filter("split = 'test'")
        return fit_best(train, held, features, label, id_cols, members, folds, seed, imbalance_threshold, oversample, use_proba)


def fit_best(train: DataFrame, held: DataFrame, features: Sequence[str], label: str, id_cols: Sequence[str], members: Mapping[str, dict], folds: int = 5, seed: int = 42, imbalance_threshold: float = 3.0, oversample: bool = False, use_proba: bool = True) -> TrainingOutcome:
    """Voting and stacking fitted on rows with a `features` vector, and the better of them
    on the held-out rows. Oversampled rows are told apart by base row and copy number."""
    from cohortry.operators.balance import imbalance, smote

    weight = None
    if oversample:
        base = F.col(id_cols[0]) if len(id_cols) == 1 else F.concat_ws("\x1f", *[F.col(c).cast("string") for c in id_cols])
        rows = train.select(base.alias("__base"), label, vector_to_array("features").alias("vec"))
        made = smote(rows, "__base", "vec", label, seed=seed).select("__base", F.col("copy").alias("__copy"), label, "vec")
        rows = rows.withColumn("__copy", F.lit(0)).unionByName(made)
        train = rows.select("__base", "__copy", label, array_to_vector("vec").alias("features"))
        id_cols = ["__base", "__copy"]
    elif imbalance(train, label, imbalance_threshold).first()["class_weight"] == "balanced":
        train, weight = with_weights(train, label), "weight"
    with persisted(train) as data:
        voting = VotingEnsemble(members).fit(data, label, weight)
        stacking = StackingEnsemble(members, folds, seed, use_proba=use_proba).fit(data, label, id_cols, weight, voting.fitted)
    scores = {"voting": evaluate_model(voting, held, label), "stacking": evaluate_model(stacking, held, label)}
    chosen = choose_model(scores["voting"], scores["stacking"], len(voting.classes))
    return TrainingOutcome(chosen, voting if chosen == "voting" else stacking, scores, voting.classes, list(features))


def training_matrix(spark: SparkSession, datasets: Mapping[str, tuple[DataFrame, Sequence[str], str, Sequence[str]]], members: Mapping[str, dict], test: float = 0.2, seed: int = 42) -> DataFrame:
    """One result row per (dataset, model): metrics, rows, features, seconds."""
    from cohortry.operators.splits import safe_split

    out = []
    for ds, (df, features, label, ids) in datasets.items():
        labelled = df.filter(F.col(label).isNotNull()).select(*dict.fromkeys([*ids, label, *features]))
        made = vectorize(safe_split(labelled, ids, label, test, seed), features)
        with persisted(made.select(label, "features", "split")) as rows:  # what fits and scores read
            train, held = rows.filter("split = 'train'"), rows.filter("split = 'test'")
            sizes = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}  # two rows
            n_train, n_test = sizes.get("train", 0), sizes.get("test", 0)
            classes = class_labels(train, label)
            for n, p in members.items():
                t0 = time.time()
                m = fit_model(p.get("learner", n), train, label, None, classes, **{k: v for k, v in p.items() if k != "learner"})
                secs = time.time() - t0
                s = evaluate_model(m, held, label)
                out.append((ds, n, s["accuracy"], s["f1_weighted"], s["roc_auc"], n_train, n_test, len(features), secs))
    return spark.createDataFrame(
        out, "dataset string, model string, accuracy double, f1_weighted double, roc_auc double, n_train bigint, n_test bigint, n_features int, seconds double"
    )


# --------------------------------------------------------------------- scoring
def score_output(df: DataFrame, id_col: str, probability: str = "probability", salt: str = "trace") -> DataFrame:
    """prediction (0-based class), confidence, trace id and time of scoring."""
    return df.select(
        id_col, V.argmax(F.col(probability)).alias("prediction"), F.col(probability).alias("probability"),
        F.array_max(probability).alias("confidence"), F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(salt))).alias("trace_id"),
        F.current_timestamp().alias("scored_at"),
    )


def save_ensemble(model: VotingEnsemble | StackingEnsemble, path: str, spark: SparkSession, features: Sequence[str], metrics: Mapping | None = None, background: DataFrame | None = None) -> None:
    """A voting or stacking ensemble: members as ml models, everything else as small
    tables beside them."""
    for n, m in model.fitted.items():
        PipelineModel(stages=[m.model]).write().overwrite().save(f"{path}/members/{n}")
    spec = {"members": {n: dict(p) for n, p in model.members.items()}, "classes": model.classes, "features": list(features), "metrics": dict(metrics or {})}
    if isinstance(model, StackingEnsemble):
        PipelineModel(stages=[model.meta_model.model]).write().overwrite().save(f"{path}/meta")
        spec |= {"folds": model.folds, "seed": model.seed, "meta": model.meta, "use_proba": model.use_proba}
    else:
        spec |= {"kind": model.kind, "weights": dict(model.weights or {})}
    spark.createDataFrame([(json.dumps(spec),)], "spec string").coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")
    if background is not None:
        background.write.mode("overwrite").parquet(f"{path}/background")


def load_ensemble(path: str, spark: SparkSession) -> tuple[VotingEnsemble | StackingEnsemble, dict]:
    spec = json.loads(spark.read.parquet(f"{path}/spec").first()["spec"])

    def loaded(folder: str, name: str) -> FittedModel:
        return FittedModel(name, PipelineModel.load(f"{path}/{folder}").stages[0], spec["classes"])

    fitted = {n: loaded(f"members/{n}", n) for n in spec["members"]}
    if "meta" in spec:
        model = StackingEnsemble(spec["members"], spec["folds"], spec["seed"], spec["meta"], spec["use_proba"], fitted, loaded("meta", spec["meta"]), spec["classes"])
    else:
        model = VotingEnsemble(spec["members"], spec["kind"], spec["weights"] or None, fitted, spec["classes"])
    return model, spec


save_voting, load_voting = save_ensemble, load_ensemble
