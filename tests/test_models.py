import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import ensemble as V
from cohortry.operators import explain as X
from cohortry.operators import models as T
from cohortry.session import scratch_dir
from cohortry.streaming.scoring import keep_newest, latest_version

MEMBERS = {"logistic": {"maxIter": 5}, "random_forest": {"numTrees": 3, "maxDepth": 3}}


def risk_frame(spark, n=120, classes=2):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5).astype(int) * (classes > 2)
    return spark.createDataFrame(
        [(i, *[float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "id bigint, a double, b double, c double, y int"
    )


def test_voting_expressions(spark):
    df = spark.range(1)
    p, q = F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.2), F.lit(0.8))
    r = df.select(V.argmax(p).alias("tie"), V.soft_vote([p, q], [3.0, 1.0]).alias("s"), V.hard_vote([F.lit("b"), F.lit("a")]).alias("h")).first()
    assert r["tie"] == 0 and r["s"] == pytest.approx([0.425, 0.575]) and r["h"] == "a"
    m = df.select(V.margin_probabilities(F.lit(0.7)).alias("p")).first()["p"]
    e = np.exp([-0.7, 0.7])
    assert m == pytest.approx(list(e / e.sum()))
    with pytest.raises(ValueError):
        T.VotingEnsemble(MEMBERS, "average")


def test_multiclass_ensembles(spark):
    df = T.vectorize(risk_frame(spark, classes=3), ["a", "b", "c"])
    v = T.VotingEnsemble(MEMBERS).fit(df, "y")
    row = v.predict(df).first()
    assert len(row["probability"]) == 3 and sum(row["probability"]) == pytest.approx(1.0)
    b = T.fit_model("gbt", df, "y", maxIter=2, maxDepth=2)
    assert sum(b.predict_proba(df).first()["probability"]) == pytest.approx(1.0)
    s = T.StackingEnsemble(MEMBERS, folds=2).fit(df, "y", ["id"])
    assert s.predict(df).count() == 120


def test_train_save_load(spark):
    got = T.train_best(risk_frame(spark), ["a", "b", "c"], "y", ["id"], MEMBERS, folds=2)
    assert got.metrics["voting"]["accuracy"] > 0.8
    df = T.vectorize(risk_frame(spark), ["a", "b", "c"])
    v = T.VotingEnsemble(MEMBERS).fit(df, "y")
    path = scratch_dir(spark)
    T.save_voting(v, path, spark, ["a", "b", "c"])
    again, spec = T.load_voting(path, spark)
    a = [r["prediction"] for r in v.predict(df).orderBy("id").collect()]
    assert a == [r["prediction"] for r in again.predict(df).orderBy("id").collect()] and spec["classes"] == [0, 1]


def test_oversampled_training(spark):
    df = risk_frame(spark, 80).filter("y = 0 OR id % 3 = 0")
    assert T.train_best(df, ["a", "b", "c"], "y", ["id"], {"logistic": {"maxIter": 3}}, folds=2, oversample=True).classes == [0, 1]


def test_choose_model():
    assert T.choose_model({"roc_auc": 0.9}, {"roc_auc": 0.9}, 2) == "voting"
    assert T.choose_model({"f1_weighted": 0.5}, {"f1_weighted": 0.6}, 3) == "stacking"
    assert T.threshold_members({"a": {"roc_auc": 0.7}, "b": {"roc_auc": 0.69}}) == ["a"]


def test_training_needs_two_classes(spark):
    df = T.vectorize(risk_frame(spark).filter("y = 1"), ["a", "b", "c"])
    with pytest.raises(ValueError):
        T.fit_model("logistic", df, "y")


def sigmoid_score(x):
    return 1.0 / (1.0 + F.exp(-(x["a"] * 2.0 - x["b"] + x["c"] * x["a"])))


def test_shapley_paths_agree_and_add_up(spark):
    df = risk_frame(spark, 12)
    bg = X.background_rows(df.filter("id < 4"), ["a", "b", "c"])
    exact = {r["id"]: r for r in X.exact_shapley(df, ["a", "b", "c"], bg, sigmoid_score).withColumn("p", sigmoid_score({f: F.col(f) for f in "abc"})).collect()}
    for r in exact.values():
        assert sum(r["phi"]) + r["base_value"] == pytest.approx(r["p"])

    def score(d):
        return d.withColumn("score", sigmoid_score({f: F.col("vec")[i] for i, f in enumerate("abc")}))

    for r in X.model_contributions(df, "id", ["a", "b", "c"], bg, score).collect():
        assert r["phi"] == pytest.approx(exact[r["id"]]["phi"])
    # sampled permutations: exact for an additive model, whatever the sample
    add = lambda d: d.withColumn("score", F.col("vec")[0] * 2 - F.col("vec")[2])
    mean = np.mean(bg, axis=0)
    for r in X.model_contributions(df, "id", ["a", "b", "c"], bg, add, permutations=8).join(df, "id").collect():
        assert r["phi"] == pytest.approx([2 * (r["a"] - mean[0]), 0.0, -(r["c"] - mean[2])])


def test_local_surrogate_recovers_a_line(spark):
    df = risk_frame(spark, 10)
    line = lambda x: x["a"] * 3.0 - x["b"] * 2.0 + 1.0
    spread = {"a": 1.0, "b": 1.0, "c": 1.0}
    rows = X.local_surrogates(df, "id", ["a", "b", "c"], line, n_samples=60, ridge=1e-9, spread=spread).collect()
    w = {(r["row_id"], r["feature"]): r for r in rows}
    src = {r["id"]: r for r in df.collect()}
    for i in range(10):
        assert w[(i, "a")]["weight"] == pytest.approx(3.0) and w[(i, "b")]["weight"] == pytest.approx(-2.0)
        assert w[(i, "c")]["weight"] == pytest.approx(0.0, abs=1e-6) and w[(i, "a")]["rank"] == 1
        assert w[(i, "a")]["intercept"] == pytest.approx(3 * src[i]["a"] - 2 * src[i]["b"] + 1) and w[(i, "a")]["fit"] == pytest.approx(1.0)


def test_pca_matches_numpy(spark):
    from cohortry.operators.similarity import embed, pca

    df = risk_frame(spark, 50)
    e = embed(df, "id", ["a", "b", "c"])
    x = np.array([r["vec"] for r in e.orderBy("id").collect()])
    got = np.array([r["components"] for r in pca(e, "id", k=2).orderBy("id").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(x @ vt[:2].T), atol=1e-6)


def test_stream_keeps_newest_over_batches(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    for lo in (0, 40):
        spark.range(lo, lo + 40).selectExpr("'m' || (id % 2) AS model", "id", "id * 2 AS ts").coalesce(1).write.mode("append").parquet(str(src))
        rows = spark.readStream.schema("model string, id bigint, ts bigint").parquet(str(src))
        keep_newest(rows, "model", ["ts", "id"], out, ck, 5, once=True).awaitTermination()
    got = sorted(r["id"] for r in spark.read.parquet(f"{out}/v={latest_version(spark, out)}").collect())
    assert got == list(range(70, 80))


def test_thresholds_move_only_rows_of_wanted_buckets(spark, monkeypatch):
    from cohortry.operators import splits as S

    kept = []
    monkeypatch.setattr(S, "checkpoint", lambda df: kept.append(df) or df.localCheckpoint(), raising=False)
    df = spark.range(20000).selectExpr("id", "int(id % 3) AS y")
    got = S.split(df, ["id"], "y", 0.25, 0)
    assert got.filter("split = 'test'").groupBy("y").count().orderBy("y").collect() == [(0, 1667), (1, 1667), (2, 1667)]
    assert len(kept) == 1 and kept[0].count() < 100  # one bucket of 4096 per class
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_stacking_takes_fitted_members(spark, monkeypatch):
    df = T.vectorize(risk_frame(spark), ["a", "b", "c"])
    voting = T.VotingEnsemble(MEMBERS).fit(df, "y")
    fits, fit = [], T.fit_model
    monkeypatch.setattr(T, "fit_model", lambda name, *a, **k: fits.append(name) or fit(name, *a, **k))
    given = T.StackingEnsemble(MEMBERS, folds=2).fit(df, "y", ["id"], fitted=voting.fitted)
    assert len(fits) == 2 * len(MEMBERS) + 1
    own = T.StackingEnsemble(MEMBERS, folds=2).fit(df, "y", ["id"])
    for a, b in zip(given.predict_proba(df).orderBy("id").collect(), own.predict_proba(df).orderBy("id").collect()):
        assert a["probability"] == pytest.approx(b["probability"])
    with pytest.raises(ValueError):
        T.StackingEnsemble({"logistic": {}}).fit(df, "y", ["id"], fitted=voting.fitted)


def test_matrix_keeps_only_what_fits_read(spark, monkeypatch):
    kept, persisted = [], T.persisted
    monkeypatch.setattr(T, "persisted", lambda df: kept.append(df.columns) or persisted(df))
    df = risk_frame(spark).withColumn("note", F.lit("unused"))
    rows = T.training_matrix(spark, {"d": (df, ["a", "b", "c"], "y", ["id"])}, MEMBERS).collect()
    assert kept[0] == ["y", "features", "split"]
    assert {(r["n_train"], r["n_test"], r["n_features"]) for r in rows} == {(96, 24, 3)}
