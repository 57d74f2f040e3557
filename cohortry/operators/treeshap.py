"""Exact interventional Shapley values of fitted tree ensembles, from leaf paths.

For a row x and a background row z, the model on the hybrid row (x on the features of S,
z elsewhere) reaches a leaf iff every feature on the leaf's path takes a value that meets
its conditions there. Features that x meets and z fails must be in S (the set A), those
that z meets and x fails must be out of S (B); a feature both fail makes the leaf
unreachable. The leaf's share of the game is v [A in S, B out of S], whose Shapley values
are v (|A|-1)! |B|! / (|A|+|B|)! for each member of A and -v |A|! (|B|-1)! / (|A|+|B|)!
for each member of B. Summed over leaves and trees and averaged over the background these
are exactly the Shapley values of the interventional game (the same numbers as scoring
every coalition against every background row), with no coalition listed and no limit on
the number of features: the work for a row is trees x leaves x path features x distinct
background patterns per leaf.

Trees come from the model's own node table (the `data` folder its writer leaves), read
by Spark; rows are explained in Arrow batches by `mapInPandas`, each task holding the
forest and the background, both of a size known on the driver before the job starts.

A fitted forest sees of a continuous feature only which thresholds lie below it, so rows
between the same thresholds (a cell) share score and contributions to the last bit. Each
occupied cell is explained once and joined back to its rows: the numpy work is bounded by
the thresholds (at most maxBins - 1 a feature) and not by the rows.

Explained output: random forest classifiers, the probability of class `output` (the mean
of the trees' leaf frequencies, as Spark scores it); gradient-boosted trees, the margin
(sum of weighted leaf values); regression trees and forests, the prediction.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.numeric import bin_of
from cohortry.operators.ranks import small_side
from cohortry.session import checkpoint, scratch_dir

#: Cells of the largest array of a block of rows: leaves x rows x background patterns.
ROW_CELLS = 1 << 21
#: Rows (one per cell of the thresholds) that one task explains.
TASK_ROWS = 512
#: Cells that are scored ahead and looked up; beyond them rows are scored themselves.
GRID_CELLS = 100_000


def node_table(spark: SparkSession, model) -> DataFrame:
    """(tree, weight, id, prediction, stats, left, right, feature, split, n_categories)."""
    folder = scratch_dir(spark, "forest-")
    model.write().save(folder)
    nodes = spark.read.parquet(f"{folder}/data")
    tree = F.col("treeID") if "treeID" in nodes.columns else F.lit(0)
    n = F.col("nodeData") if "nodeData" in nodes.columns else F.struct(*[F.col(c) for c in nodes.columns])
    nodes = nodes.select(tree.alias("tree"), n.alias("n")).select(
        "tree", F.col("n.id").alias("id"), F.col("n.prediction").alias("prediction"), F.col("n.impurityStats").alias("stats"),
        F.col("n.leftChild").alias("left"), F.col("n.rightChild").alias("right"), F.col("n.split.featureIndex").alias("feature"),
        F.col("n.split.leftCategoriesOrThreshold").alias("split"), F.col("n.split.numCategories").alias("n_categories"),
    )
    try:
        weights = spark.read.parquet(f"{folder}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
        return nodes.join(weights, "tree", "left").fillna(1.0, ["weight"])
    except Exception:  # a single tree has no tree metadata  # noqa: BLE001
        return nodes.withColumn("weight", F.lit(1.0))


def _kind(model) -> str:
    name = type(model).__name__
    if name.startswith("RandomForestClassification") or name.startswith("DecisionTreeClassification"):
        return "frequency"
    return "value"


class Forest:
    """Per tree: leaves with value and, per feature on the path, the condition met there.

    A condition is an interval (lo, hi] for a continuous feature, or a set of categories."""

    def __init__(self, nodes: pd.DataFrame, kind: str, output: int, mean: bool):
        self.trees = []
        self._cache = {}
        n_trees = nodes["tree"].nunique()
        for t, g in nodes.groupby("tree", sort=True):
            by_id = {int(r.id): r for r in g.itertuples(index=False)}
            leaves = []
            stack = [(0, {})]
            while stack:
                at, conds = stack.pop()
                r = by_id[at]
                if r.left < 0:
                    if kind == "frequency":
                        s = np.asarray(r.stats, dtype=np.float64)
                        v = s[output] / s.sum() if s.sum() > 0 else 0.0
                    else:
                        v = float(r.prediction)
                    leaves.append((v, conds))
                    continue
                f = int(r.feature)
                for child, left in ((int(r.left), True), (int(r.right), False)):
                    c = dict(conds)
                    if r.n_categories < 0:
                        lo, hi = c.get(f, (-np.inf, np.inf))
                        t_ = float(r.split[0])
                        c[f] = (lo, min(hi, t_)) if left else (max(lo, t_), hi)
                    else:
                        cats = set(range(int(r.n_categories))) if f not in c else set(c[f])
                        chosen = {float(x) for x in r.split}
                        c[f] = frozenset(x for x in cats if (float(x) in chosen) == left)
                    stack.append((child, c))
            weight = float(g["weight"].iloc[0]) / (n_trees if mean else 1)
            self.trees.append((weight, leaves))

    def meets(self, x: np.ndarray, leaves) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ok (L, K, R): row r meets the k-th path feature of leaf l; feature (L, K); used (L, K)."""
        feat, lo, hi, used, cats = self._slots(leaves)
        v = x[:, feat]  # (R, L, K)
        ok = ((v > lo) & (v <= hi)).transpose(1, 2, 0)
        for li, ki, allowed in cats:
            ok[li, ki] = np.isin(x[:, feat[li, ki]], allowed)
        return ok, feat, used

    def _slots(self, leaves):
        key = id(leaves)
        if key not in self._cache:
            k = max((len(c) for _, c in leaves), default=0)
            feat = np.zeros((len(leaves), k), dtype=np.int64)
            lo, hi = np.full((len(leaves), k), -np.inf), np.full((len(leaves), k), np.inf)
            used = np.zeros((len(leaves), k), dtype=bool)
            cats = []
            for li, (_, conds) in enumerate(leaves):
                for ki, (f, cond) in enumerate(sorted(conds.items())):
                    feat[li, ki], used[li, ki] = f, True
                    if isinstance(cond, frozenset):
                        cats.append((li, ki, np.asarray(sorted(cond), dtype=np.float64)))
                    else:
                        lo[li, ki], hi[li, ki] = cond
            self._cache[key] = (feat, lo, hi, used, cats)
        return self._cache[key]


class Cells:
    """The cells between the thresholds of a fitted tree model, one axis per feature."""

    def __init__(self, nodes: pd.DataFrame, d: int):
        inner = nodes[nodes["left"] >= 0]
        self.categorical = {int(f) for f in inner.loc[inner["n_categories"] >= 0, "feature"]}
        cuts: dict[int, set[float]] = {i: set() for i in range(d)}
        for f, split, n in zip(inner["feature"], inner["split"], inner["n_categories"]):
            if n < 0:
                cuts[int(f)].add(float(split[0]))
        self.axes = [[*sorted(cuts[i]), math.inf] for i in range(d)]

    def snap(self, x: Column, i: int) -> Column:
        """The upper end of the cell of x on axis i, by binary search; a category as it is.
        NaN goes to the last cell, as in the trees of Spark."""
        if i in self.categorical:
            return x

        def search(ends: list[float]) -> Column:
            if len(ends) == 1:
                return F.lit(ends[0])
            mid = (len(ends) - 1) // 2
            return F.when(x <= F.lit(ends[mid]), search(ends[: mid + 1])).otherwise(search(ends[mid + 1 :]))

        return search(self.axes[i])

    def snapped(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        """df with every feature at the upper end of its cell: the model scores it alike."""
        return df.withColumns({f: self.snap(F.col(f"`{f}`").cast("double"), i) for i, f in enumerate(features)})

    def code(self, features: Sequence[str]) -> Column:
        """The number of a row's cell: its bin on the last axis plus, times the bins there,
        that on the axis before, and so on (continuous features only)."""
        out = F.lit(0)
        for i, f in enumerate(features):
            out = out * F.lit(len(self.axes[i])) + bin_of(F.col(f"`{f}`").cast("double"), self.axes[i][:-1])
        return out

    def lookup(self, spark: SparkSession, score):
        """score(df with `vec`) as a lookup by cell for snapped rows, where the cells are few."""
        if self.categorical or math.prod(len(a) for a in self.axes) > GRID_CELLS:
            return score
        grid = spark.createDataFrame([(self.axes,)], "a array<array<double>>").repartition(1)
        for i in range(len(self.axes)):
            grid = grid.withColumn(f"v{i}", F.explode(F.col("a")[i]))
        grid = grid.select(F.array(*[F.col(f"v{i}") for i in range(len(self.axes))]).alias("vec"))
        return CellScores(self, small_side(score(grid.repartition(spark.sparkContext.defaultParallelism)).select("vec", "score")))


class CellScores:
    """The scores of all cells: a scorer of snapped rows with `vec`, and by cell number."""

    def __init__(self, cells: Cells, scored: DataFrame):
        self.cells, self.scored = cells, scored

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.join(self.scored, "vec")

    def by_code(self) -> np.ndarray:
        rows = self.scored.toPandas()  # at most GRID_CELLS rows
        x = np.vstack(rows["vec"].to_numpy())
        at = np.zeros(len(x), dtype=np.int64)
        for i, ends in enumerate(self.cells.axes):
            at = at * len(ends) + np.searchsorted(ends, x[:, i])
        out = np.full(len(x), np.nan)
        out[at] = rows["score"].to_numpy(dtype=np.float64)
        return out


def _weights(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """wa[a, b] = (a-1)! b! / (a+b)!, wb[a, b] = a! (b-1)! / (a+b)!."""
    wa, wb = np.zeros((depth + 1, depth + 1)), np.zeros((depth + 1, depth + 1))
    for a in range(depth + 1):
        for b in range(depth + 1 - a):
            if a:
                wa[a, b] = math.factorial(a - 1) * math.factorial(b) / math.factorial(a + b)
            if b:
                wb[a, b] = math.factorial(a) * math.factorial(b - 1) / math.factorial(a + b)
    return wa, wb


def _patterns(forest: Forest, background: np.ndarray, leaves, n_features: int):
    """What a tree needs of the background: distinct fail patterns per leaf with counts."""
    v = np.array([lv for lv, _ in leaves])
    okz, feat, used = forest.meets(background, leaves)
    base = float((v * okz.all(axis=1).sum(axis=1)).sum()) / len(background)
    k = feat.shape[1]
    if k == 0:
        return v, base, None
    fz = ~okz & used[:, :, None]
    codes = (fz.astype(np.int64) << np.arange(k)[None, :, None]).sum(axis=1)  # (L, Z)
    pats = [np.unique(c, return_counts=True) for c in codes]
    u = max(len(p[0]) for p in pats)
    pz = np.zeros((len(leaves), k, u))
    cnt = np.zeros((len(leaves), u))
    for li, (c, n) in enumerate(pats):
        pz[li, :, : len(c)] = (c[None, :] >> np.arange(k)[:, None]) & 1
        cnt[li, : len(c)] = n
    onehot = np.zeros((len(leaves) * k, n_features))
    onehot[np.arange(len(leaves) * k), feat.ravel()] = used.ravel()
    return v, base, (pz, cnt, pz.sum(axis=1).astype(np.int64), onehot, _weights(k), used)


def explain_rows(forest: Forest, background: np.ndarray, x: np.ndarray, n_features: int, prepared=None) -> tuple[np.ndarray, np.ndarray, float]:
    """(phi (R, n_features), value (R,), base value) of rows x against the background."""
    phi = np.zeros((len(x), n_features))
    value = np.zeros(len(x))
    base = 0.0
    z_n = len(background)
    for t, (weight, leaves) in enumerate(forest.trees):
        v, tree_base, more = prepared[t] if prepared is not None else _patterns(forest, background, leaves, n_features)
        okx, _, _ = forest.meets(x, leaves)
        base += weight * tree_base
        value += weight * (v[:, None] * okx.all(axis=1)).sum(axis=0)
        if more is None:
            continue
        pz, cnt, a, onehot, (wa, wb), used = more
        n_leaves, k, u = pz.shape
        step = max(1, ROW_CELLS // (n_leaves * u))
        for s in range(0, len(x), step):
            fx = (~okx[:, :, s : s + step] & used[:, :, None]).astype(np.float64)  # (L, K, R)
            b = fx.sum(axis=1).astype(np.int64)  # (L, R)
            free = np.matmul(fx.transpose(0, 2, 1), pz) == 0  # (L, R, U)
            wgt = free * cnt[:, None, :] * v[:, None, None]
            ga = wgt * wa[a[:, None, :], b[:, :, None]]
            gb = (wgt * wb[a[:, None, :], b[:, :, None]]).sum(axis=2)  # (L, R)
            per_slot = np.matmul(ga, pz.transpose(0, 2, 1)) - fx.transpose(0, 2, 1) * gb[:, :, None]  # (L, R, K)
            rows = per_slot.shape[1]
            phi[s : s + rows] += weight / z_n * (per_slot.transpose(1, 0, 2).reshape(rows, n_leaves * k) @ onehot)
    return phi, value, base


def tree_contributions(
    df: DataFrame, id_col: str, features: Sequence[str], model, background: Sequence[Sequence[float]], output: int = 1
) -> DataFrame:
    """id, phi (array over features), value (the explained output), base_value.

    phi sums to value - base_value for every row. `background` is a list of feature rows
    (its size is the caller's bound). Features are read as doubles and must not be null,
    as for the model itself. Other columns of df are ignored.
    """
    spark = df.sparkSession
    kind = _kind(model)
    mean = type(model).__name__.startswith("RandomForest")
    nodes = node_table(spark, model).toPandas()  # the model is on the driver already
    forest = Forest(nodes, kind, output, mean)
    bg = np.asarray(background, dtype=np.float64).reshape(len(background), len(features))
    d = len(features)

    def run(batches):
        prepared = [_patterns(forest, bg, leaves, d) for _, leaves in forest.trees]  # once a task
        for b in batches:
            x = np.vstack(b["__x"].to_numpy()) if len(b) else np.zeros((0, d))
            phi, value, base = explain_rows(forest, bg, x, d, prepared)
            yield pd.DataFrame({"__x": b["__x"], "phi": list(phi), "value": value, "base_value": base})

    x = [f"`{f}`" for f in features]
    rows = Cells(nodes, d).snapped(df.select(id_col, *x), features).select(F.col(id_col).alias("__id"), F.array(*x).alias("__x"))
    cells = checkpoint(rows.select("__x").distinct())
    tasks = max(spark.sparkContext.defaultParallelism, -(-cells.count() // TASK_ROWS))
    explained = cells.repartition(tasks).mapInPandas(run, "__x array<double>, phi array<double>, value double, base_value double")
    return rows.join(small_side(explained), "__x").select(F.col("__id").alias(id_col), "phi", "value", "base_value")
