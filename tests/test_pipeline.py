"""The whole risk model on raw frames, stored and loaded, and its explanations."""

import numpy as np
import pytest

from cohortry.operators import explain as X
from cohortry.operators import models as T
from cohortry.operators.pipeline import RiskPipeline, fit_pipeline
from cohortry.operators.preprocess import Preprocessor
from cohortry.session import scratch_dir

MEMBERS = {"logistic": {"maxIter": 10}, "random_forest": {"numTrees": 3, "maxDepth": 3}}


def patients(spark, n=150):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        a, b = float(rng.normal()), float(rng.normal())
        site = "north" if rng.random() < 0.5 else "south"
        risk = "high" if a > 0.7 else "low" if a < -0.3 else "middle"
        rows.append((f"p{i}", None if i % 11 == 0 else a, float("nan") if i % 13 == 0 else b, None if i % 7 == 0 else site, None if i == 5 else risk))
    return spark.createDataFrame(rows, "patient string, a double, b double, site string, risk string")


@pytest.mark.parametrize("imputation,oversample,use_proba", [("median", True, False), ("knn", False, True)])
def test_raw_frame_to_stored_model(spark, imputation, oversample, use_proba):
    df = patients(spark)
    p = fit_pipeline(df, "risk", ["patient"], MEMBERS, Preprocessor(numeric_imputation=imputation), folds=2, oversample=oversample, use_proba=use_proba, background=8)
    assert p.features == ["a", "b", "site_south"] and p.metrics[p.chosen]["accuracy"] > 0.6 and p.background.count() == 8
    new = df.drop("risk")
    want = {r["patient"]: r["prediction"] for r in p.predict(new).collect()}
    assert len(want) == 150 and set(want.values()) <= {"high", "middle", "low"}
    path = scratch_dir(spark)
    p.save(spark, path)
    again = RiskPipeline.load(spark, path)
    assert {r["patient"]: r["prediction"] for r in again.predict(new).collect()} == want and again.metrics == p.metrics


def test_explanations_add_up_for_the_predicted_class(spark):
    df = patients(spark)
    p = fit_pipeline(df, "risk", ["patient"], MEMBERS, folds=2, background=6)
    some = df.filter("patient IN ('p1', 'p2', 'p3', 'p4')").drop("risk")
    base = p.model.predict_proba(T.vectorize(p.background, p.features)).collect()
    base = np.mean([r["probability"] for r in base], axis=0)
    want = {r["patient"]: (r["prediction"], r["probability"]) for r in p.predict(some).collect()}
    for permutations in (None, 5):
        rows = p.explain(some, "patient", permutations).collect()
        assert len(rows) == 12
        for k, (label, prob) in want.items():
            mine = [r for r in rows if r["row_id"] == k]
            at = p.model.classes.index(label)
            assert {r["prediction"] for r in mine} == {label}
            assert sum(r["contribution"] for r in mine) == pytest.approx(prob[at] - base[at], abs=1e-9)


def test_stacking_is_stored(spark):
    df = T.vectorize(patients(spark).na.drop().filter("NOT isnan(b)"), ["a", "b"])
    s = T.StackingEnsemble(MEMBERS, folds=2, use_proba=False).fit(df, "risk", ["patient"])
    path = scratch_dir(spark)
    T.save_ensemble(s, path, spark, ["a", "b"])
    again, _ = T.load_ensemble(path, spark)
    first, second = ({r["patient"]: r["prediction"] for r in m.predict(df).collect()} for m in (s, again))
    assert first == second and again.use_proba is False


def test_key_findings(spark):
    rows = [("heart_disease_uci", "cp", 0.4), ("heart_disease_uci", "ca", 0.2), ("x", "b", 0.3), ("x", "a", 0.3), ("x", "c", 0.1), ("x", "d", 0.05)]
    got = X.key_findings(spark.createDataFrame(rows, "dataset string, feature string, importance double"))
    assert [r["finding"] for r in got.orderBy("dataset", "position").collect()] == [
        "Most predictive feature: cp (importance: 0.400)", "Top cardiovascular risk factors: cp, ca",
        "Most important feature: a", "Top predictive features: a, b, c",
    ]
