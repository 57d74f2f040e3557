"""Contributions of fitted tree ensembles from leaf paths, against scoring every coalition."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from cohortry.operators import explain as X
from cohortry.operators import treeshap as T


def frame(spark, n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(2)
    x[:, 0] = rng.integers(0, 3, n)  # a feature with few values, used as categories below
    y = ((x[:, 1] + x[:, 2] * x[:, 0] + rng.normal(scale=0.5, size=n)) > 0.3).astype(float)
    cols = [f"f{j}" for j in range(d)]
    df = spark.createDataFrame([(k, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))], ["id", *cols, "label"])
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df), cols


def scorer(model, kind):
    def score(df):
        out = model.transform(df.withColumn("features", array_to_vector("vec")))
        if kind == "probability":
            return out.withColumn("score", vector_to_array("probability")[1])
        if kind == "margin":
            return out.withColumn("score", vector_to_array("rawPrediction")[1])
        return out.withColumn("score", F.col("prediction"))

    return score


@pytest.mark.parametrize(
    ("make", "kind"),
    [
        (lambda: RandomForestClassifier(numTrees=6, maxDepth=4, seed=3), "probability"),
        (lambda: GBTClassifier(maxIter=4, maxDepth=3, seed=3), "margin"),
        (lambda: RandomForestRegressor(numTrees=4, maxDepth=4, seed=3), "value"),
        (lambda: DecisionTreeClassifier(maxDepth=5, seed=3), "probability"),
    ],
)
def test_tree_paths_equal_all_coalitions(spark, make, kind):
    df, cols = frame(spark, 300, 5, 1)
    model = make().fit(df)
    rows = df.where("id < 25")
    background = [[float(v) for v in r] for r in df.where("id >= 280").select(*cols).collect()]
    got = {r["id"]: r for r in T.tree_contributions(rows, "id", cols, model, background).collect()}
    want = {r["id"]: r["phi"] for r in X.model_contributions(rows, "id", cols, background, scorer(model, kind)).collect()}
    for k, phi in want.items():
        assert np.allclose(got[k]["phi"], phi, atol=1e-9, rtol=0), k
        assert abs(sum(got[k]["phi"]) - (got[k]["value"] - got[k]["base_value"])) < 1e-9


def test_categorical_splits(spark):
    from pyspark.ml.feature import VectorIndexer

    df, cols = frame(spark, 300, 4, 2)
    df = VectorIndexer(inputCol="features", outputCol="indexed", maxCategories=3).fit(df).transform(df)
    model = RandomForestClassifier(numTrees=5, maxDepth=4, seed=1, featuresCol="indexed").fit(df)
    rows = df.where("id < 20")
    background = [[float(v) for v in r] for r in df.where("id >= 290").select(*cols).collect()]
    got = {r["id"]: r["phi"] for r in T.tree_contributions(rows, "id", cols, model, background).collect()}

    def score(d):
        out = model.transform(d.withColumn("indexed", array_to_vector("vec")))
        return out.withColumn("score", vector_to_array("probability")[1])

    for r in X.model_contributions(rows, "id", cols, background, score).collect():
        assert np.allclose(got[r["id"]], r["phi"], atol=1e-9, rtol=0)


def test_forty_features_sum_to_value(spark):
    df, cols = frame(spark, 400, 40, 5)
    model = RandomForestClassifier(numTrees=10, maxDepth=8, seed=2).fit(df)
    background = [[float(v) for v in r] for r in df.where("id >= 300").select(*cols).collect()]  # 100 rows
    out = T.tree_contributions(df.where("id < 60"), "id", cols, model, background)
    scored = model.transform(df.where("id < 60")).select("id", vector_to_array("probability")[1].alias("p"))
    for r in out.join(scored, "id").collect():
        assert len(r["phi"]) == 40
        assert abs(r["value"] - r["p"]) < 1e-12
        assert abs(sum(r["phi"]) - (r["p"] - r["base_value"])) < 1e-9
    assert T.tree_contributions(df.where("false"), "id", cols, model, background).count() == 0


def test_scored_frames_permutation_equals_sql(spark):
    import __spark_entry__ as entry
    from conftest import SMALL
    from oracle import compare, connect

    ok, message = compare(entry.queries()["x02_permutation_scored_frames"](spark, SMALL), entry.oracle_sql()["x02_permutation_scored_frames"], connect(SMALL))
    assert ok, message


def test_forest_permutation_metrics_with_numpy(spark):
    df, cols = frame(spark, 240, 4, 9)
    model = RandomForestClassifier(numTrees=8, maxDepth=4, seed=4).fit(df)
    score = scorer(model, "probability")
    got = {r["feature"]: r for r in X.model_permutation_importance(df, "id", cols, "label", score, repeats=3).collect()}
    v = X.permutation_variants(df, "id", cols, "label", repeats=3)
    rows = score(v).select("feature", "rep", "id", "label", "vec", "score").collect()
    orig = {r["id"]: [r[c] for c in cols] for r in df.collect()}
    for r in rows:  # a variant differs from its row in its own feature only
        j = cols.index(r["feature"]) if r["feature"] else None
        assert all(a == b for k, (a, b) in enumerate(zip(r["vec"], orig[r["id"]], strict=True)) if k != j)
    for f in cols:  # each repeat takes the column's values in another order
        for rep in (1, 2, 3):
            taken = sorted(r["vec"][cols.index(f)] for r in rows if r["feature"] == f and r["rep"] == rep)
            assert taken == sorted(v_[cols.index(f)] for v_ in orig.values())

    def auc(y, p):
        y, p = np.asarray(y), np.asarray(p)
        pos, neg = p[y == 1], p[y == 0]
        return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))

    def metrics(feature, rep):
        sel = [r for r in rows if r["feature"] == feature and r["rep"] == rep]
        y, p = [r["label"] for r in sel], [r["score"] for r in sel]
        return auc(y, p), np.mean([(q >= 0.5) == (t == 1) for q, t in zip(p, y, strict=True)])

    b_auc, b_acc = metrics("", 0)
    for f in cols:
        drops = np.array([[b_auc - a, b_acc - c] for a, c in (metrics(f, rep) for rep in (1, 2, 3))])
        assert abs(got[f]["importance_mean"] - drops[:, 0].mean()) < 1e-12 and abs(got[f]["importance_std"] - drops[:, 0].std()) < 1e-9
        assert abs(got[f]["accuracy_drop_mean"] - drops[:, 1].mean()) < 1e-12 and abs(got[f]["accuracy_drop_std"] - drops[:, 1].std()) < 1e-9


def test_rows_of_a_cell_are_scored_and_explained_alike(spark):
    df, cols = frame(spark, 300, 3, 6)
    model = RandomForestClassifier(numTrees=5, maxDepth=3, maxBins=8, seed=7).fit(df)
    score = scorer(model, "probability")
    cells = T.Cells(T.node_table(spark, model).toPandas(), len(cols))
    vec = F.array(*cols).alias("vec")
    snapped = cells.snapped(df, cols).select("id", vec)
    assert snapped.select("vec").distinct().count() < 300
    want = {r["id"]: r["score"] for r in score(df.select("id", vec)).collect()}
    got = {r["id"]: r["score"] for r in cells.lookup(spark, score)(snapped).collect()}
    assert got == want
    background = [[float(v) for v in r] for r in df.where("id >= 280").select(*cols).collect()]
    one = {r["id"]: (r["phi"], r["value"]) for r in T.tree_contributions(df, "id", cols, model, background).collect()}
    two = T.tree_contributions(cells.snapped(df, cols), "id", cols, model, background).collect()
    assert one == {r["id"]: (r["phi"], r["value"]) for r in two} and len(two) == 300


def test_counted_scores_equal_repeated_rows(spark):
    from cohortry.operators.metrics import ranking_scores

    rows = [(0.2, 0, 3), (0.2, 1, 2), (0.7, 1, 4), (0.9, 0, 1)]
    counted = ranking_scores(spark.createDataFrame(rows, "p double, y int, n long"), "y", "p", (), "n").first()
    long = ranking_scores(spark.createDataFrame([(p, y) for p, y, n in rows for _ in range(n)], "p double, y int"), "y", "p").first()
    assert counted == long


def crowded(spark, n, seed=3):
    """Rows that crowd few cells: a continuous feature, three of few values."""
    rng = np.random.default_rng(seed)
    a, b, c, d = rng.normal(size=n).round(4), rng.integers(0, 3, n) / 2.0, rng.integers(0, 2, n), rng.integers(0, 2, n)
    y = (a + b + rng.normal(size=n) > 0.5).astype(int)
    rows = [(i, float(p), float(q), float(r), float(s), int(t), float(t)) for i, (p, q, r, s, t) in enumerate(zip(a, b, c, d, y))]
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, x3 double, x4 double, y int, label_index double"), ["x1", "x2", "x3", "x4"]


def test_forest_of_counted_cells(spark, monkeypatch):
    """Trees are fitted on cells and draws of their rows, in the features' own thresholds."""
    from cohortry.operators import models as M

    df, cols = crowded(spark, 12_000)
    rows = M.learner("random_forest", numTrees=12, maxDepth=5).fit(M.vectorize(df, cols))
    whole = M.spread
    monkeypatch.setattr(M, "spread", lambda *a: pytest.fail("rows are fitted"))
    model = M.fit_forest(df, "id", cols, numTrees=12, maxDepth=5)
    again = M.fit_forest(df.repartition(3, "y", "x2"), "id", cols, numTrees=12, maxDepth=5)
    assert model.getNumTrees == 12 and model.numFeatures == 4 and model.numClasses == 2 and model.getMaxDepth() == 5
    nodes = T.node_table(spark, model).toPandas()
    top = nodes[nodes["id"] == 0]
    drawn = [sum(s) for s in top["stats"]]
    assert len(set(drawn)) > 6 and abs(np.mean(drawn) - 12_000) < 200  # sums of draws, one a tree
    axes = T.Cells(nodes, 4).axes
    assert axes[1] == [0.25, 0.75, np.inf] and axes[2] == [0.5, np.inf] and 8 < len(axes[0]) <= 32
    y = np.array([r["y"] for r in df.orderBy("id").collect()])

    def scores(m):
        got = m.transform(M.vectorize(df, cols)).orderBy("id").select(vector_to_array("probability")[1].alias("p")).collect()
        return np.array([r["p"] for r in got])

    p, q = scores(model), scores(rows)
    assert np.corrcoef(p, q)[0, 1] > 0.97 and abs(((p - y) ** 2).mean() - ((q - y) ** 2).mean()) < 4e-3
    assert np.array_equal(p, scores(again))  # whatever the partitions
    background = [[float(v) for v in r] for r in df.where("id < 20").select(*cols).collect()]
    phi = T.tree_contributions(df, "id", cols, model, background).orderBy("id").collect()
    assert np.allclose([r["value"] for r in phi], p) and np.allclose([sum(r["phi"]) + r["base_value"] for r in phi], p)
    assert max(abs(sum(s[k] for s in top["stats"]) / sum(drawn) - (y == k).mean()) for k in (0, 1)) < 0.01
    monkeypatch.setattr(M, "spread", whole)
    some = df.limit(700)  # cells are as many as rows: the rows themselves
    want = M.learner("random_forest", numTrees=3, cacheNodeIds=True).fit(M.vectorize(M.spread(some, "id"), cols))
    assert M.fit_forest(some, "id", cols, numTrees=3).toDebugString.split("\n", 1)[1] == want.toDebugString.split("\n", 1)[1]


def test_split_points_are_those_of_the_trees(spark):
    from cohortry.operators import models as M

    df, cols = crowded(spark, 4000)
    model = RandomForestClassifier(numTrees=40, maxDepth=8, maxBins=12, seed=1, labelCol="y").fit(M.vectorize(df, cols))
    axes = T.Cells(T.node_table(spark, model).toPandas(), 4).axes
    rows = df.toPandas()
    for i, c in enumerate(cols):
        assert set(axes[i][:-1]) <= set(M.split_points(rows[c].to_numpy(), 12)) and len(axes[i]) > (8 if i == 0 else 1)


@pytest.mark.parametrize("block", [37, 1 << 21])
def test_variants_counted_by_cells(spark, monkeypatch, block):
    """Counts by cell numbers are those of scoring every variant."""
    from cohortry.operators import models as M

    df, cols = crowded(spark, 301)
    model = RandomForestClassifier(numTrees=5, maxDepth=4, maxBins=8, seed=7, labelCol="y").fit(M.vectorize(df, cols))
    odd = df.withColumn("y", F.when(F.col("id") % 50 != 7, F.col("y"))).withColumn("x1", F.when(F.col("id") == 5, float("nan")).otherwise(F.col("x1")))
    score = scorer(model, "probability")
    cells = T.Cells(T.node_table(spark, model).toPandas(), 4)
    monkeypatch.setattr(X, "BLOCK_VARIANTS", block)
    known = cells.lookup(spark, score)
    got = X.counted_variants(odd, "id", cols, "y", known, repeats=4)
    every = score(X.permutation_variants(odd.withColumn("x1", F.nanvl("x1", F.lit(1e300))), "id", cols, "y", repeats=4))
    want = every.groupBy("feature", "rep", "y", F.col("score").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    one = X.model_permutation_importance(df, "id", cols, "y", known, repeats=4).orderBy("feature").collect()
    two = X.model_permutation_importance(df, "id", cols, "y", score, repeats=4).orderBy("feature").collect()
    assert np.allclose([r[1:] for r in one], [r[1:] for r in two], atol=1e-12) and len(one) == 4
