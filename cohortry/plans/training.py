"""Training, ensembles and their evaluation (M), on the orders features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.operators import models as T
from cohortry.operators.splits import split
from cohortry.plans import scorecard as S
from cohortry.plans.catalog import query, table
from cohortry.plans.scorecard import FEATURES
from cohortry.session import scratch_dir

# small settings: the queries show the operators, not a tuned model
MEMBERS = {
    "logistic": {"maxIter": 10},
    "random_forest": {"numTrees": 5, "maxDepth": 4},
}
LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ALL = {**MEMBERS, "gbt": {"maxIter": 3, "maxDepth": 3}, "linear_svm": {"maxIter": 5}}


def data(spark, d):
    b = S.base(spark, d).withColumn("y", (F.col("x1") + F.col("x2") * 0.3 + F.pmod(F.hash("id"), F.lit(100)) / 100 > 4.0).cast("int"))
    return T.vectorize(split(b, ["id"], "y", 0.25, 0), FEATURES).select("id", "y", "o_orderstatus", "features", "split", *FEATURES)


def parts(spark, d):
    x = data(spark, d)
    return x.filter("split = 'train'"), x.filter("split = 'test'")


def metric_rows(spark, rows):
    flat = [(m, k, float(v)) for m, s in rows.items() for k, v in s.items()]
    return spark.createDataFrame(flat, "model string, metric string, value double")


@query("m01_base_learners")
def m01(spark, d):
    train, test = parts(spark, d)
    with T.persisted(train) as tr:
        out = {n: T.evaluate_model(T.fit_model(n, tr, "y", **p), test, "y") for n, p in ALL.items()}
    return metric_rows(spark, out)


@query("m01_multiclass_boosting")
def m01b(spark, d):
    train, test = parts(spark, d)
    m = T.fit_model("gbt", train, "o_orderstatus", **ALL["gbt"])
    return m.predict_proba(test).select("id", T.label_of(m.classes, F.col("probability")).alias("label"), F.array_max("probability").alias("confidence"))


@query("m04_stacking")
def m04(spark, d):
    train, test = parts(spark, d)
    st = T.StackingEnsemble(MEMBERS, folds=3).fit(train, "y", ["id"])
    return metric_rows(spark, {"stacking": T.evaluate_model(st, test, "y")})


@query("m05_stacking_inference")
def m05(spark, d):
    train, test = parts(spark, d)
    st = T.StackingEnsemble({"logistic": {"maxIter": 5}, "tree": {"learner": "random_forest", "numTrees": 2, "maxDepth": 3}}, folds=2).fit(train, "y", ["id"])
    p = st.predict(test)
    return p.select("id", "prediction", F.col("probability")[1].alias("p1"))


@query("m06_grid_search")
def m06(spark, d):
    train, _ = parts(spark, d)
    best, score, results = T.grid_search("logistic", train, "y", {"regParam": [0.0, 0.1], "maxIter": [5]}, ["id"], folds=3)
    rows = [(str(sorted(p.items())), float(s), p == best) for p, s in results]
    return spark.createDataFrame(rows, "params string, roc_auc double, best boolean")


@query("m07_cross_validation")
def m07(spark, d):
    train, _ = parts(spark, d)
    return metric_rows(spark, {"logistic": T.cross_validate("logistic", train, "y", ["id"], folds=3, maxIter=5)})


@query("m08_choose_ensemble")
def m08(spark, d):
    with T.persisted(data(spark, d).select("id", "y", "features", "split")) as x:
        train, test = x.filter("split = 'train'"), x.filter("split = 'test'")
        voting = T.VotingEnsemble(MEMBERS).fit(train, "y")
        stacking = T.StackingEnsemble(MEMBERS, folds=2).fit(train, "y", ["id"], fitted=voting.fitted)
        v, s = T.evaluate_model(voting, test, "y"), T.evaluate_model(stacking, test, "y")
    chosen = T.choose_model(v, s, 2)
    return metric_rows(spark, {"voting": v, "stacking": s}).withColumn("chosen", F.col("model") == chosen)


@query("m09_threshold_ensemble")
def m09(spark, d):
    train, test = parts(spark, d)
    ens, results = T.threshold_ensemble(MEMBERS, train, test, "y", 0.6)
    if ens is not None:
        results = {**results, "ensemble": T.evaluate_model(ens, test, "y")}
    return metric_rows(spark, results)


@query("m10_training_matrix")
def m10(spark, d):
    b = S.base(spark, d)
    li = table(spark, d, "lineitem").select(
        *LINE_ID, "l_quantity", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("y")
    )
    sets = {"orders": (b, FEATURES, "y", ["id"]), "lineitem": (li, ["l_quantity", "l_discount", "l_tax"], "y", LINE_ID)}
    return T.training_matrix(spark, sets, MEMBERS).drop("seconds")


@query("m11_train_best")
def m11(spark, d):
    x = data(spark, d).drop("features", "split")
    got = T.train_best(x, FEATURES, "y", ["id"], MEMBERS, folds=2)
    return metric_rows(spark, got.metrics).withColumn("chosen", F.col("model") == got.chosen)


@query("m13_persisted_ensemble")
def m13(spark, d):
    train, test = parts(spark, d)
    v = T.VotingEnsemble(MEMBERS).fit(train, "y")
    path = scratch_dir(spark)
    T.save_voting(v, path, spark, FEATURES)
    again, _ = T.load_voting(path, spark)
    p = again.predict(test)
    return p.select("id", "prediction", F.col("probability")[1].alias("p1"))
