"""Nearest neighbours, oversampling and clustering against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.operators import balance as B
from cohortry.operators import cohorts as C
from cohortry.operators import knn as K


def frame(spark, x, name="qid"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} bigint, vec array<double>")


def brute(x, metric, k, floor=None):
    s = np.round(metric.score(x, x), K.SCORE_DIGITS)
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))
        out[i] = [j for j in order if floor is None or s[i, j] >= floor][:k]
    return out


def points(n=160, d=3):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, d))
    x[: n // 3] = x[0]  # a third of all rows are copies
    return x


@pytest.mark.parametrize("pivots,block", [(1, 32), (6, 16)])
def test_weighted_similarity(spark, pivots, block):
    x, m = points(), K.weighted_similarity()
    got = K.nearest(frame(spark, x), frame(spark, x, "cid"), 4, m, floor=0.3, block_rows=block, pivots=pivots).collect()
    have = {}
    for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
        have.setdefault(r["qid"], []).append(r["cid"])
    want = {i: v for i, v in brute(x, m, 4, 0.3).items() if v}
    assert have == want


def test_euclidean_pruned(spark):
    x, m = points(120, 2), K.euclidean()
    got = K.nearest(frame(spark, x), frame(spark, x, "cid"), 3, m, block_rows=8, pivots=5).collect()
    have = {}
    for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
        have.setdefault(r["qid"], []).append(r["cid"])
    assert have == brute(x, m, 3)


def test_k_larger_than_corpus(spark):
    x = points(3, 2) + np.arange(3)[:, None]
    assert K.nearest(frame(spark, x), frame(spark, x, "cid"), 10, K.cosine()).count() == 6


@pytest.mark.parametrize("pivots", [None, 1, 7])
def test_cosine_with_bound(spark, pivots):
    """Scaled copies, opposite vectors and zero vectors, through the cells."""
    x = points(150, 4)
    x[100:110] = x[60:70] * 3.0
    x[110:115] = -x[60:65]
    x[115:118] = 0.0
    have = {}
    for r in K.nearest(frame(spark, x), frame(spark, x, "cid"), 5, K.cosine(), block_rows=16, pivots=pivots).orderBy("rank").collect():
        have.setdefault(r["qid"], []).append(r["cid"])
    assert have == brute(x, K.cosine(), 5)


def test_nearest_in_an_empty_corpus(spark):
    x = points(6, 2)
    none = frame(spark, x, "cid").limit(0)
    assert K.nearest(frame(spark, x), none, 3, K.weighted_similarity()).count() == 0
    assert K.nearest(frame(spark, x).limit(0), frame(spark, x, "cid"), 3, K.euclidean()).count() == 0


def test_knn_impute_falls_back_to_mean(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, None), (3, None, 4.0)], "id bigint, a double, b double")
    got = {r["id"]: (r["a"], r["b"]) for r in K.knn_impute(df, "id", ["a", "b"], 2).collect()}
    assert got == {1: (1.0, 4.0), 2: (3.0, 4.0), 3: (2.0, 4.0)}


def holes(n, d, seed):
    """Rows with holes in many patterns, copies, whole numbers that tie, empty rows."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 3)
    x[:, 1] = rng.integers(0, 4, n)
    x[n // 2 : n // 2 + n // 8] = x[: n // 8]
    x[rng.random((n, d)) < 0.3] = np.nan
    return x


def brute_fills(x, k):
    """Fills of NaN cells by every pair of rows; rows infinitely far are not near."""
    out = x.copy()
    for i, j in zip(*np.nonzero(np.isnan(x))):
        with np.errstate(invalid="ignore", divide="ignore"):
            diff = x[i] - x
            shared = (~np.isnan(diff)).sum(axis=1)
            dist = np.round(np.sqrt((np.nan_to_num(diff, posinf=np.inf, neginf=np.inf) ** 2).sum(axis=1) * (x.shape[1] / shared)), 12)
        near = [c for c in np.argsort(dist, kind="stable") if shared[c] and np.isfinite(dist[c]) and not np.isnan(x[c, j])][:k]
        out[i, j] = np.mean(x[near, j]) if near else np.nanmean(x[:, j])
    return out


@pytest.mark.parametrize("d,pair_cost,region_rows", [(3, 0, 32), (5, 0, 20), (5, 12, 20), (5, 0, 4096), (4, 10**9, 32)])
def test_knn_impute_equals_every_pair(spark, d, pair_cost, region_rows):
    """By patterns through many regions, by patterns and pairs mixed, and by pairs."""
    x = holes(400, d, d)
    x[7, 0], x[9, 0], x[11, 0] = np.inf, -np.inf, np.inf
    assert len({tuple(r) for r in np.isnan(x)}) > (20 if d == 5 else 7)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    names = [f"f{j}" for j in range(d)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names))
    got = {r["id"]: [r[c] for c in names] for r in K.knn_impute(df, "id", names, 3, pair_cost=pair_cost, region_rows=region_rows).collect()}
    assert len(got) == 400
    np.testing.assert_allclose(np.array([got[i] for i in range(400)]), brute_fills(x, 3), atol=1e-9)


def test_knn_impute_of_other_rows(spark):
    """Donors from a table of their own, NaN neither filled nor compared."""
    x, y = holes(300, 3, 21), holes(200, 3, 22)
    names = ["a", "b", "c"]

    def table(v):
        rows = [(i, *[None if np.isnan(c) else float(c) for c in r]) for i, r in enumerate(v)]
        return spark.createDataFrame(rows, "id long, a double, b double, c double")

    odd = table(y).withColumn("b", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("b")))
    want = {tuple(r) for r in K.knn_impute(odd, "id", names, 4, table(x), pair_cost=10**9).collect() if r["id"] != 3}
    one = K.knn_impute(odd, "id", names, 4, table(x), pair_cost=0, region_rows=16).collect()
    assert {tuple(r) for r in one if r["id"] != 3} == want and len(one) == 200
    assert np.isnan(next(r["b"] for r in one if r["id"] == 3))


def test_knn_impute_leaves_pairs_out(spark, tmp_path, monkeypatch):
    """Rows compared grow slower than receivers times donors."""
    import dataclasses

    log, plain = str(tmp_path / "pairs"), K.nan_euclidean()

    def score(q, c):
        with open(log, "a") as f:
            f.write(f"{len(q) * len(c)}\n")
        return plain.score(q, c)

    monkeypatch.setattr(K, "nan_euclidean", lambda: dataclasses.replace(plain, score=score))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(16_000, 3))
    x[:8000, 0], x[8000:12_000, 1] = np.nan, np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = K.knn_impute(df, "id", ["a", "b", "c"], 5).agg(F.count("a"), F.sum("a"), F.sum("b")).first()
    compared = sum(int(line) for line in open(log))
    assert got[0] == 16_000 and compared < (8000 * 8000 + 4000 * 12_000) / 5


def test_smote_levels_classes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0 if i < 90 else 1, [float(v) for v in rng.normal(size=3)]) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, y int, vec array<double>")
    new = B.smote(df, "id", "vec", "y").collect()
    assert len(new) == 80 and {r["y"] for r in new} == {1}
    by_id = {r[0]: np.array(r[2]) for r in rows}
    for r in new:  # on the segment between base and neighbour
        a, b, v = by_id[r["id"]], by_id[r["neighbour"]], np.array(r["vec"])
        t = np.dot(v - a, b - a) / np.dot(b - a, b - a)
        assert 0 <= t <= 1 and np.allclose(a + t * (b - a), v)


def test_imbalance(spark):
    def of(sizes):
        return B.imbalance(spark.createDataFrame([(y,) for y, n in sizes.items() for _ in range(n)], "y int"), "y").first()

    assert tuple(of({0: 90, 1: 10})) == ("balanced", 9.0)
    assert of({0: 60, 1: 55})["class_weight"] is None
    assert tuple(of({0: 5})) == (None, 1.0)


def brute_dbscan(x, eps, m):
    n = len(x)
    near = [[j for j in range(n) if np.linalg.norm(x[i] - x[j]) <= eps] for i in range(n)]
    core = [len(v) >= m for v in near]
    label = [-1] * n
    c = 0
    for i in range(n):
        if core[i] and label[i] == -1:
            stack, label[i] = [i], c
            while stack:
                for j in near[stack.pop()]:
                    if core[j] and label[j] == -1:
                        label[j] = c
                        stack.append(j)
            c += 1
    return [label[i] if core[i] else min([label[j] for j in near[i] if core[j]], default=-1) for i in range(n)]


@pytest.mark.parametrize("pair_limit", [1_000_000, 6])
def test_dbscan_matches_brute_force(spark, pair_limit):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 0.4, (60, 2)), rng.normal(4, 0.5, (50, 2)), rng.uniform(-4, 8, (40, 2)), np.full((70, 2), 0.3)]
    x = np.c_[x][rng.permutation(len(x))]
    chain = np.c_[np.arange(30) * 0.4 + 20, np.zeros(30)]  # one long thin cluster
    x = np.r_[x, chain]
    got = C.dbscan(frame(spark, x, "id"), "id", 0.5, 3, pair_limit=pair_limit).orderBy("id").collect()
    assert [r["cohort"] for r in got] == brute_dbscan(x, 0.5, 3)


def test_dbscan_of_ten_dimensions(spark):
    """A dense hot cell, a chain, copies and noise beyond the looked-up dimensions."""
    rng = np.random.default_rng(8)
    x = np.r_[rng.normal(0, 0.03, (80, 10)), rng.normal(0, 0.2, (60, 10)), np.full((20, 10), 2.0), rng.uniform(-1, 1, (40, 10))]
    chain = np.zeros((25, 10))
    chain[:, 9] = np.arange(25) * 0.2 + 3  # differs in the last dimension only
    x = np.r_[x[rng.permutation(len(x))], chain]
    got = C.dbscan(frame(spark, x, "id"), "id", 0.5, 4, pair_limit=500).orderBy("id").collect()
    want = brute_dbscan(x, 0.5, 4)
    assert [r["cohort"] for r in got] == want and max(want) >= 2 and -1 in want


def test_dbscan_all_noise(spark):
    x = np.arange(10)[:, None] * 5.0
    assert {r["cohort"] for r in C.dbscan(frame(spark, x, "id"), "id", 0.5, 2).collect()} == {-1}


def test_kmeans_separates(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 0.1, (20, 2)), rng.normal(9, 0.1, (20, 2))]
    got = [r["cohort"] for r in C.kmeans_cohorts(frame(spark, x, "id"), "id", 2, 2).orderBy("id").collect()]
    assert len(set(got[:20])) == 1 and len(set(got[20:])) == 1 and got[0] != got[20]


def test_profile_of_empty_text_is_unknown(spark):
    df = spark.createDataFrame([(1, 0, 2.0, None), (2, -1, 9.0, "x")], "id int, cohort int, v double, s string")
    got = {r["characteristic"]: (r["number"], r["mode"]) for r in C.cohort_profiles(df, "cohort", "id").collect()}
    assert got == {"size": (1.0, None), "v_mean": (2.0, None), "v_std": (None, None), "s_mode": (None, "unknown")}
    assert C.cohort_profiles(df.filter(F.col("cohort") == -1), "cohort", "id").count() == 0


@pytest.mark.parametrize("pivots", [1, 5])
def test_text_ids(spark, pivots):
    x, m = points(60, 2), K.weighted_similarity()
    name = lambda c: F.concat(F.lit("p"), F.lpad(F.col(c).cast("string"), 4, "0")).alias(c)
    q, c = frame(spark, x).select(name("qid"), "vec"), frame(spark, x, "cid").select(name("cid"), "vec")
    have = {}
    for r in K.nearest(q, c, 4, m, block_rows=16, pivots=pivots).orderBy("rank").collect():
        have.setdefault(int(r["qid"][1:]), []).append(int(r["cid"][1:]))
    assert have == brute(x, m, 4)
    by = C.dbscan(q.withColumnRenamed("qid", "id"), "id", 0.5, 3).orderBy("id").collect()
    assert [r["cohort"] for r in by] == brute_dbscan(x, 0.5, 3)


@pytest.mark.parametrize("metric", ["weighted", "euclidean"])
@pytest.mark.parametrize("rows", [100, 100_000])
def test_regions_of_boxes_equal_brute_force(spark, metric, rows):
    """Copies, ties on a lattice, rows near the origin and outliers, over many regions and one."""
    rng = np.random.default_rng(4)
    x = np.vstack([points(150, 3), rng.integers(-2, 3, (150, 3)), rng.normal(size=(500, 3)) * 0.01, rng.normal(size=(100, 3)) * 50]).astype(float)
    m, floor = (K.weighted_similarity(), 0.3) if metric == "weighted" else (K.euclidean(), None)
    got = K.nearest(frame(spark, x), frame(spark, x, "cid"), 4, m, floor=floor, region_rows=rows).collect()
    have = {}
    for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
        have.setdefault(r["qid"], []).append(r["cid"])
    assert have == {i: v for i, v in brute(x, m, 4, floor).items() if v}


def test_a_region_visits_few_rows():
    """The pairs scored per query do not grow with the rows of the region."""
    import pandas as pd

    rng = np.random.default_rng(5)
    seen = {}
    for n in (4000, 16000):
        inner, count = K.weighted_similarity(), [0]

        def score(q, c, inner=inner, count=count):
            count[0] += len(q) * len(c)
            return inner.score(q, c)

        x = rng.normal(size=(n, 4))
        rows = pd.DataFrame({"qid": np.arange(n), "vec": list(x), "kth": 0.3})
        K._region_topk(K.Metric(score, upper=inner.upper), 11, 0.3)(rows, rows.rename(columns={"qid": "cid"}))
        seen[n] = count[0] / n
    assert seen[16000] < 1.5 * seen[4000]
    assert seen[16000] < 16000 / 3


def test_a_tile_hands_on_only_scores_that_can_count():
    """With the score so far, a tile of cells emits no lower row and none of the home cell;
    scores found through one float32 product equal the sums of the metric."""
    from cohortry.operators.knn import _tile_topk, cosine

    rng = np.random.default_rng(9)
    q, c = rng.normal(size=(40, 16)), rng.normal(size=(9000, 16))
    c[5], c[6], c[7] = 0.0, q[3] * 1e90, q[3]
    own = np.arange(9000) % 3
    exact = np.round(cosine().score(q, c), 12)
    kth = np.sort(exact, axis=1)[:, -20]
    cs = pd.DataFrame({"cid": np.arange(9000), "vec": list(c), "own": own})
    got = _tile_topk(cosine(), 6, None)(pd.DataFrame({"qid": np.arange(40), "vec": list(q), "home": 1, "kth": kth}), cs)
    want = []
    for i in range(40):
        ok = sorted((-exact[i, j], j) for j in range(9000) if own[j] != 1 and exact[i, j] >= kth[i])
        want += [(i, j, -s) for s, j in ok[:6]]
    assert [tuple(r) for r in got[["qid", "cid", "score"]].itertuples(index=False)] == want
    c[8, 0] = np.nan  # no product stands for it: the sums are used throughout
    cs["vec"] = list(c)
    assert cosine().fast(q, c) is None
    got = _tile_topk(cosine(), 6, None)(pd.DataFrame({"qid": np.arange(40), "vec": list(q), "home": 1, "kth": kth}), cs)
    assert [tuple(r) for r in got[["qid", "cid", "score"]].itertuples(index=False)] == [w for w in want if w[1] != 8]


def test_kmeans_passes_over_few_partitions(spark):
    """Partitions, and with them the results sent to the driver, do not follow the input's."""
    rows = [(i, [float(i % 2) * 10 + (i % 7) * 0.01]) for i in range(400)]
    e = spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(64, "id")
    out = C.kmeans_cohorts(e, "id", 2, n_init=1)
    assert out.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted(r["count"] for r in out.groupBy("cohort").count().collect()) == [200, 200]
