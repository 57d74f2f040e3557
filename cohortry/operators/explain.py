"""Feature attributions for scored rows.

A scorer is a function from a dict of feature columns to a score column, so that
linear and expression models stay inside code generation. Models that only score
DataFrames go through `model_contributions`. Contributions are one array per row
until they are exploded; ranks inside a row need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.functions.seeded import seeded_hash, seeded_normal
from cohortry.operators.metrics import ranking_scores
from cohortry.operators.ranks import global_rank
from cohortry.session import checkpoint

Scorer = Callable[[Mapping[str, Column]], Column]
MAX_BACKGROUND = 512
MAX_EXACT_FEATURES = 10
BLOCK_VARIANTS = 1 << 21  # rows of a block whose variants are counted together


# ------------------------------------------------------------- contributions
def contribution_rows(df: DataFrame, id_col: str, features: Sequence[str], phi: Column, keep: Sequence[str] = ()) -> DataFrame:
    """row_id, feature, value, contribution, rank (by magnitude, ties by feature order)."""
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), phi[i].alias("contribution")
            )
            for i, f in enumerate(features)
        ]
    )
    ordered = F.array_sort(F.transform(cells, lambda c: F.struct((-F.abs(c["contribution"])).alias("m"), c["i"].alias("i"), c.alias("c"))))
    return df.select(F.col(id_col).alias("row_id"), *keep, F.posexplode(ordered).alias("p", "o")).select(
        "row_id", *keep, "o.c.feature", "o.c.value", "o.c.contribution", (F.col("p") + 1).alias("rank")
    )


def background_means(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(f).alias(f) for f in features]).first()  # one row
    return {f: float(row[f]) for f in features}


def linear_contributions(features: Sequence[str], weights: Sequence[float], means: Mapping[str, float]) -> Column:
    """phi_j = w_j (x_j - E[x_j]), exact for a linear margin."""
    return F.array(*[F.lit(float(w)) * (F.col(f) - F.lit(means[f])) for f, w in zip(features, weights)])


def background_rows(df: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """A bounded background as literals. Larger tables must be sampled first."""
    rows = df.select(*[F.col(f).cast("double") for f in features]).limit(MAX_BACKGROUND + 1).collect()
    if len(rows) > MAX_BACKGROUND:
        raise ValueError(f"background above {MAX_BACKGROUND} rows; sample it first")
    if not rows:
        raise ValueError("empty background")
    return [list(r) for r in rows]


def coalition_weight(size: int, d: int) -> float:
    return factorial(size) * factorial(d - size - 1) / factorial(d)


def _background_literal(background: Sequence[Sequence[float]]) -> Column:
    text = ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in row) + ")" for row in background)
    return F.expr(f"array({text})")


def coalition_values(features: Sequence[str], background, score: Scorer) -> Column:
    """Array of v(S) for every subset S by bit mask: mean score over the background
    with the features of S taken from the row."""
    d = len(features)
    if d > MAX_EXACT_FEATURES:
        raise ValueError(f"{d} features; exact coalitions stop at {MAX_EXACT_FEATURES}")
    bg = _background_literal(background)

    def mean_with(mask: int) -> Column:
        def add(acc, b):
            return acc + score({f: F.col(f) if mask >> j & 1 else b[j] for j, f in enumerate(features)})

        return F.aggregate(bg, F.lit(0.0), add) / F.lit(float(len(background)))

    return F.array(*[mean_with(mask) for mask in range(1 << d)])


def shapley_from_values(v: str, d: int) -> Column:
    """Exact Shapley values from the array column of v(S)."""
    phis = []
    for i in range(d):
        terms = [
            f"{coalition_weight(bin(mask).count('1'), d)!r}D * ({v}[{mask | 1 << i}] - {v}[{mask}])"
            for mask in range(1 << d)
            if not mask >> i & 1
        ]
        phis.append(" + ".join(terms))
    return F.expr(f"array({', '.join(phis)})")


def exact_shapley(df: DataFrame, features: Sequence[str], background, score: Scorer, out: str = "phi") -> DataFrame:
    """Adds phi (array) and base_value to rows of an expression model."""
    v = df.withColumn("__v", coalition_values(features, background, score))
    return v.withColumns({out: shapley_from_values("__v", len(features)), "base_value": F.col("__v")[0]}).drop("__v")


def mean_over_background(features: Sequence[str], background, score: Scorer, from_row: Sequence[str]) -> Column:
    """Mean score over the background with `from_row` features taken from the row."""
    bg = _background_literal(background)

    def one(acc, b):
        return acc + score({f: F.col(f) if f in from_row else b[j] for j, f in enumerate(features)})

    return F.aggregate(bg, F.lit(0.0), one) / F.lit(float(len(background)))


def _designs(d: int, permutations: int | None, seed: int) -> list[tuple[list[bool], list[float]]]:
    """(mask, coefficient per feature): contributions are the sums of the mean score over
    the background, with the masked features of the row, times the coefficient. Exact over
    all coalitions, or sampled permutations; equal masks are one design."""
    if permutations is None:
        out = []
        for mask in range(1 << d):
            size = bin(mask).count("1")
            coef = [coalition_weight(size - 1, d) if mask >> j & 1 else -coalition_weight(size, d) for j in range(d)]
            out.append(([bool(mask >> j & 1) for j in range(d)], coef))
        return out
    rng = np.random.default_rng(seed)
    merged: dict[tuple[bool, ...], list[float]] = {}
    for _ in range(permutations):
        order = rng.permutation(d)
        mask = [False] * d
        for step in range(d + 1):
            if step > 0:
                mask[order[step - 1]] = True
            coef = merged.setdefault(tuple(mask), [0.0] * d)
            if step > 0:
                coef[order[step - 1]] += 1.0 / permutations
            if step < d:
                coef[order[step]] -= 1.0 / permutations
    return [(list(m), c) for m, c in merged.items()]


def model_contributions(
    df: DataFrame, id_col: str, features: Sequence[str], background, score: Callable[[DataFrame], DataFrame],
    permutations: int | None = None, seed: int = 42, outputs: int | None = None,
) -> DataFrame:
    """id, phi for a model that scores DataFrames: score(df with `vec`) adds `score`.

    With `outputs`, score is an array of so many outputs (one per class) and phi has an
    array per output. Each row meets every background row under every design; the scores
    are folded into one sum per feature before the shuffle, so it carries about one row per
    input row."""
    d = len(features)
    designs = ", ".join(
        "struct(array(" + ", ".join("true" if m else "false" for m in mask) + ") AS m, array(" + ", ".join(f"{c / len(background)!r}D" for c in coef) + ") AS w)"
        for mask, coef in _designs(d, permutations, seed)
    )
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    long = df.select(id_col, x.alias("__x")).select(id_col, "__x", F.explode(F.expr(f"array({designs})")).alias("__d"))
    long = long.select("*", F.explode(_background_literal(background)).alias("__b"))
    mixed = F.zip_with(
        F.zip_with("__x", "__b", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.col("__d.m"), lambda s, m: F.when(m, s["a"]).otherwise(s["b"])
    )
    scored = score(long.select(id_col, F.col("__d.w").alias("__w"), mixed.alias("vec")))
    ones = [F.col("score")] if outputs is None else [F.col("score")[c] for c in range(outputs)]
    sums = scored.groupBy(id_col).agg(*[F.sum(s * F.col("__w")[j]).alias(f"__p{c}_{j}") for c, s in enumerate(ones) for j in range(d)])
    phis = [F.array(*[F.col(f"__p{c}_{j}") for j in range(d)]) for c in range(len(ones))]
    return sums.select(id_col, (phis[0] if outputs is None else F.array(*phis)).alias("phi"))


# ------------------------------------------------------------ global summaries
def global_importance(contributions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean |phi| per feature."""
    return contributions.groupBy(*keys, "feature").agg(F.avg(F.abs("contribution")).alias("importance"))


def ensemble_importance(importances: DataFrame) -> DataFrame:
    """importances: model, feature, importance. Mean over members, normalized to 1."""
    mean = importances.groupBy("feature").agg(F.avg("importance").alias("m"))
    whole = Window.partitionBy()  # over the feature rows
    total = F.sum("m").over(whole)
    return mean.select("feature", F.when(total > 0, F.col("m") / total).otherwise(F.col("m")).alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )


def risk_split(contributions: DataFrame, top: int = 5) -> DataFrame:
    """Per row: risk and protective features among the first `top`, the sum of phi, the
    sum of |phi|, and whether all are zero."""
    c = F.col("contribution")
    item = F.struct("rank", "feature")
    names = lambda cond: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when((F.col("rank") <= top) & cond, item))), lambda s: s["feature"]), ","
    )
    return contributions.groupBy("row_id").agg(
        names(c > 0).alias("top_risk_factors"),
        names(c < 0).alias("top_protective_factors"),
        F.sum(c).alias("prediction_impact"),
        F.sum(F.abs(c)).alias("sum_abs"),
        (F.max(F.abs(c)) <= 1e-9).alias("all_zero"),
    )


def compare_methods(importances: DataFrame, methods: Sequence[str]) -> DataFrame:
    """feature by method, missing as 0."""
    return importances.groupBy("feature").pivot("method", list(methods)).agg(F.first("importance")).na.fill(0.0, list(methods))


def mean_of_top(importances: DataFrame, top: int = 5) -> DataFrame:
    """Mean importance per feature over the methods that rank it in their first `top`."""
    w = Window.partitionBy("method").orderBy(F.desc("importance"), "feature")
    head = importances.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
    return head.groupBy("feature").agg(F.avg("importance").alias("importance"))


def grouped_importance(importances: DataFrame, groups: DataFrame) -> DataFrame:
    """groups: feature, grp. Sum per group, the remainder as Other; positive named
    groups only."""
    j = importances.join(groups, "feature", "left").select(F.coalesce("grp", F.lit("Other")).alias("grp"), "importance")
    s = j.groupBy("grp").agg(F.sum("importance").alias("importance"))
    return s.filter((F.col("importance") > 0) | (F.col("grp") == "Other"))


# Clinical groups of features, modifiable and non-modifiable factors.
CLINICAL_GROUPS = {
    "demographics": ["age", "sex"], "vitals": ["blood_pressure", "heart_rate"],
    "laboratory": ["glucose", "cholesterol"], "lifestyle": ["smoking", "exercise"],
}
MODIFIABLE = ["smoking", "exercise", "diet_quality", "stress_level", "bmi"]
NON_MODIFIABLE = ["age", "sex", "family_history"]


def risk_factors(importances: DataFrame, groups: DataFrame) -> DataFrame:
    """aspect, finding: top three features, leading clinical group, intervention potential."""
    imp = F.col("importance")
    head = importances.orderBy(F.desc("importance"), "feature").limit(3)
    top = head.groupBy().agg(
        F.array_sort(F.collect_list(F.struct((-imp).alias("k"), F.col("feature")))).alias("l")
    ).filter(F.size("l") >= 3)
    primary = top.select(
        F.lit("Primary Risk Factors").alias("aspect"),
        F.concat(F.lit("Most influential: "), F.array_join(F.transform("l", lambda s: s["feature"]), ", ")).alias("finding"),
    )
    named = grouped_importance(importances, groups).filter("grp <> 'Other'")
    domain = named.groupBy().agg(F.min_by("grp", F.struct(-imp, F.col("grp"))).alias("g")).filter("g IS NOT NULL").select(
        F.lit("Key Clinical Domain").alias("aspect"), F.concat("g", F.lit(" factors most important")).alias("finding")
    )
    change = importances.groupBy().agg(
        F.coalesce(F.sum(F.when(F.col("feature").isin(MODIFIABLE), imp)), F.lit(0.0)).alias("m"),
        F.coalesce(F.sum(F.when(F.col("feature").isin(NON_MODIFIABLE), imp)), F.lit(0.0)).alias("n"),
    )
    potential = change.select(
        F.lit("Intervention Potential").alias("aspect"),
        F.when(F.col("m") > F.col("n"), "High - many modifiable risk factors").otherwise("Moderate - focus on lifestyle changes").alias("finding"),
    )
    return primary.unionByName(domain).unionByName(potential)


# Advice per dataset; a null pattern applies always, patterns of a dataset
# are tried in order and the first match per feature counts.
INSIGHT_RULES = [
    ("heart_disease_uci", 1, "cp", "Chest pain type is highly predictive - detailed pain assessment crucial"),
    ("heart_disease_uci", 2, "thalach", "Maximum heart rate achieved during exercise is significant"),
    ("heart_disease_uci", 3, "oldpeak", "ST depression (oldpeak) indicates exercise-induced ischemia"),
    ("heart_disease_uci", 4, "ca", "Number of major vessels colored by fluoroscopy is important"),
    ("heart_disease_uci", 5, "thal", "Thalassemia status affects cardiac risk assessment"),
    ("breast_cancer_wisconsin", 1, None, "Focus on morphological features with highest predictive value"),
    ("breast_cancer_wisconsin", 2, None, "Consider texture and area measurements for diagnostic accuracy"),
    ("breast_cancer_wisconsin", 3, None, "Worst-case features often more predictive than mean values"),
    ("diabetes_130_hospitals", 1, None, "Monitor patients with high number of previous emergency visits"),
    ("diabetes_130_hospitals", 2, None, "Consider medication count as readmission risk factor"),
    ("diabetes_130_hospitals", 3, None, "Age and length of stay are significant predictors"),
    ("other", 1, None, "Focus clinical attention on high-importance features"),
    ("other", 2, None, "Consider feature interactions in clinical decision-making"),
]


def insight_rows(top_features: DataFrame) -> DataFrame:
    """top_features: dataset, feature. Advice rows: by feature pattern, or general."""
    from cohortry.operators.lookup import literal_table

    spark = top_features.sparkSession
    rules = literal_table(spark, INSIGHT_RULES, "rule_set string, rule int, pattern string, advice string")
    known = sorted({r[0] for r in INSIGHT_RULES if r[0] != "other"})
    keyed = top_features.withColumn("rule_set", F.when(F.col("dataset").isin(known), F.col("dataset")).otherwise("other"))
    by_feature = keyed.join(rules.filter("pattern IS NOT NULL"), "rule_set").filter(F.col("feature").contains(F.col("pattern")))
    by_feature = by_feature.groupBy("dataset", "feature").agg(F.min_by("advice", "rule").alias("advice"))
    general = keyed.select("dataset", "rule_set").distinct().join(rules.filter("pattern IS NULL"), "rule_set")
    return by_feature.unionByName(general.select("dataset", F.lit(None).cast("string").alias("feature"), "advice"))


# How the key findings of a dataset are worded.
FINDING_WORDS = [
    ("heart_disease_uci", "Most predictive feature", True, "Top cardiovascular risk factors"),
    ("breast_cancer_wisconsin", "Most predictive feature", True, "Key diagnostic features"),
    ("diabetes_130_hospitals", "Most predictive factor", True, "Key readmission predictors"),
    ("other", "Most important feature", False, "Top predictive features"),
]


def key_findings(importances: DataFrame) -> DataFrame:
    """importances: dataset, feature, importance. dataset, position, finding: the leading
    feature of each dataset, then its first three (ties by name)."""
    from cohortry.operators.lookup import literal_table

    words = literal_table(importances.sparkSession, FINDING_WORDS, "rule_set string, lead string, with_value boolean, list string")
    w = Window.partitionBy("dataset").orderBy(F.desc("importance"), "feature")
    head = importances.select("dataset", "feature", "importance", F.row_number().over(w).alias("r")).filter("r <= 3")
    top = head.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("r", "feature", "importance"))).alias("l"))
    known = [r[0] for r in FINDING_WORDS if r[0] != "other"]
    top = top.withColumn("rule_set", F.when(F.col("dataset").isin(known), F.col("dataset")).otherwise("other")).join(words, "rule_set")
    first = F.col("l")[0]
    value = F.when(F.col("with_value"), F.concat(F.lit(" (importance: "), F.format_string("%.3f", first["importance"]), F.lit(")"))).otherwise("")
    lines = F.array(
        F.concat("lead", F.lit(": "), first["feature"], value),
        F.concat("list", F.lit(": "), F.array_join(F.transform("l", lambda s: s["feature"]), ", ")),
    )
    return top.select("dataset", F.posexplode(lines).alias("p", "finding")).select("dataset", (F.col("p") + 1).alias("position"), "finding")


# ------------------------------------------------------- permutation importance
def permutation_importance(
    df: DataFrame, id_col: str, features: Sequence[str], y: str, score: Scorer, repeats: int = 5, seed: int = 42
) -> DataFrame:
    """feature, mean and std of the AUC drop over repeats.

    Rows get one random rank by seeded hash. Repeat r takes each permuted value from
    the row a seeded number of ranks further (cyclic), so all features and repeats
    come from one rank, one join per repeat and one keyed metric pass."""
    cols = [id_col, y, *features]
    base = df.select(*cols).withColumn("__h", seeded_hash(str(seed), id_col))
    ranked = global_rank(base, ["__h", id_col], out="__r").drop("__h")
    n = df.count()
    if n < 2:
        raise ValueError("permutation needs two rows or more")
    shift = F.pmod(seeded_hash(f"shift{seed}", "rep"), F.lit(n - 1)) + 1
    reps = ranked.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    reps = reps.withColumn("__s", F.pmod(F.col("__r") - 1 + shift, F.lit(n)) + 1)
    donors = ranked.select(F.col("__r").alias("__s"), *[F.col(f).alias(f"__d_{f}") for f in features])
    joined = reps.join(donors, "__s")
    cells = [
        F.struct(F.lit(f).alias("feature"), score({g: F.col(f"__d_{g}") if g == f else F.col(g) for g in features}).alias("p"))
        for f in features
    ]
    permuted = joined.select("rep", y, F.explode(F.array(*cells)).alias("c")).select("c.feature", "rep", y, "c.p")
    base_rows = df.select(F.lit("").alias("feature"), F.lit(0).alias("rep"), y, score({g: F.col(g) for g in features}).alias("p"))
    auc = ranking_scores(permuted.unionByName(base_rows), y, "p", ["feature", "rep"]).select("feature", "rep", "roc_auc")
    whole = Window.partitionBy()  # over features x repeats rows
    drop = auc.withColumn("base", F.max(F.when(F.col("rep") == 0, F.col("roc_auc"))).over(whole)).filter("rep > 0")
    return drop.groupBy("feature").agg(
        F.avg(F.col("base") - F.col("roc_auc")).alias("importance_mean"),
        F.stddev_pop(F.col("base") - F.col("roc_auc")).alias("importance_std"),
    )


def permutation_variants(df: DataFrame, id_col: str, features: Sequence[str], y: str, repeats: int = 10, seed: int = 42) -> DataFrame:
    """(feature, rep, id, y, vec): every row once as it is (feature '', rep 0) and once for
    every feature and repeat with that feature taken from another row.

    The permutations are those of `permutation_importance`: one seeded rank of the rows,
    and repeat r takes the value from a seeded number of ranks further (cyclic), so all
    features and repeats come from one join. Features are read as doubles."""
    if repeats < 1:
        raise ValueError("repeats must be 1 or more")
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    base = df.select(id_col, y, x.alias("vec")).withColumn("__h", seeded_hash(str(seed), id_col))
    ranked = checkpoint(global_rank(base, ["__h", id_col], out="__r").drop("__h"))
    n = ranked.count()
    if n < 2:
        raise ValueError("permutation needs two rows or more")
    shift = F.pmod(seeded_hash(f"shift{seed}", "rep"), F.lit(n - 1)) + 1
    reps = ranked.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    reps = reps.withColumn("__s", F.pmod(F.col("__r") - 1 + shift, F.lit(n)) + 1)
    donors = ranked.select(F.col("__r").alias("__s"), F.col("vec").alias("__d"))
    joined = reps.join(donors, "__s")
    swapped = [
        F.struct(F.lit(f).alias("feature"), F.array(*[F.col("__d")[j] if j == i else F.col("vec")[j] for j in range(len(features))]).alias("vec"))
        for i, f in enumerate(features)
    ]
    variants = joined.select("rep", id_col, y, F.explode(F.array(*swapped)).alias("c")).select("c.feature", "rep", id_col, y, "c.vec")
    return variants.unionByName(ranked.select(F.lit("").alias("feature"), F.lit(0).alias("rep"), id_col, y, "vec"))


def counted_variants(df: DataFrame, id_col: str, features: Sequence[str], y: str, cells, repeats: int = 10, seed: int = 42) -> DataFrame:
    """(feature, rep, y, p, n): how many variants of `permutation_variants` have each score,
    for a scorer that knows the scores of all cells of the features (`CellScores`).

    A row is the number of its cell. Rows in the order of their rank are packed into blocks
    of cell numbers; repeat r sends a block to the one or two blocks that take from it, and
    every variant is then arithmetic on cell numbers and a count, inside one task."""
    if repeats < 1:
        raise ValueError("repeats must be 1 or more")
    n = df.count()
    if n < 2:
        raise ValueError("permutation needs two rows or more")
    spark, kind = df.sparkSession, df.schema[y].dataType
    sizes = [len(a) for a in cells.cells.axes]
    steps = [int(np.prod(sizes[i + 1 :], dtype=np.int64)) for i in range(len(sizes))]
    scores, rank_of = np.unique(cells.by_code(), return_inverse=True)
    width = len(scores)
    reps = spark.range(1, repeats + 1).select(F.col("id").cast("int").alias("rep"))
    shifts = {r["rep"]: r["s"] for r in reps.select("rep", (F.pmod(seeded_hash(f"shift{seed}", "rep"), F.lit(n - 1)) + 1).alias("s")).collect()}
    block = min(BLOCK_VARIANTS, max(1 << 14, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    base = df.select(id_col, F.col(y).cast("double").alias("y"), cells.cells.code(features).alias("code"), seeded_hash(str(seed), id_col).alias("__h"))
    ranked = global_rank(base, ["__h", id_col], out="__r").select((F.col("__r") - 1).alias("at"), "code", "y")

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        codes, ys = rows["code"].to_numpy(dtype=np.int32), rows["y"].to_numpy(dtype=np.float64)
        return pd.DataFrame({"block": [key[0]], "codes": [codes.tobytes()], "ys": [ys.tobytes()]})

    blocks = ranked.withColumn("block", F.floor(F.col("at") / F.lit(block)))
    blocks = checkpoint(blocks.groupBy("block").applyInPandas(pack, "block bigint, codes binary, ys binary"))

    def give(frames):
        for f in frames:
            for b, raw in zip(f["block"], f["codes"]):
                codes = np.frombuffer(raw, dtype=np.int32)
                for rep, s in shifts.items():
                    pos = 0
                    while pos < len(codes):
                        i = (b * block + pos - s) % n  # the row that takes from the one at pos
                        to = i // block
                        some = min(len(codes) - pos, (to + 1) * block - i, n - i)
                        yield pd.DataFrame({"block": [to], "rep": [rep], "start": [i - to * block], "taken": [codes[pos : pos + some].tobytes()]})
                        pos += some

    taken = blocks.select("block", "codes").mapInPandas(give, "block bigint, rep int, start bigint, taken binary")

    def count(rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        codes = np.frombuffer(rows["codes"].iloc[0], dtype=np.int32)
        classes, of = np.unique(np.frombuffer(rows["ys"].iloc[0]), return_inverse=True)
        out = []

        def add(feature, rep, at):
            found = np.bincount(rank_of[at] + of * width, minlength=width * len(classes)).reshape(len(classes), width)
            out.extend((feature, rep, c, found[k].astype(np.int32).tobytes()) for k, c in enumerate(classes))

        add(-1, 0, codes)
        own = [codes // step % size for step, size in zip(steps, sizes)]
        for rep, some in parts.groupby("rep"):
            other = np.empty(len(codes), dtype=np.int32)
            for start, raw in zip(some["start"], some["taken"]):
                piece = np.frombuffer(raw, dtype=np.int32)
                other[start : start + len(piece)] = piece
            for i, (step, size) in enumerate(zip(steps, sizes)):
                add(i, int(rep), codes + (other // step % size - own[i]) * step)
        return pd.DataFrame(out, columns=["feature", "rep", "y", "counts"])

    counted = blocks.groupBy("block").cogroup(taken.groupBy("block")).applyInPandas(count, "feature int, rep int, y double, counts binary")

    def total(key, rows: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(width, dtype=np.int64)
        for raw in rows["counts"]:
            found += np.frombuffer(raw, dtype=np.int32)
        at = np.flatnonzero(found)
        return pd.DataFrame({"feature": key[0], "rep": key[1], "y": key[2], "p": scores[at], "n": found[at]})

    # null in y is NaN here and one key; Python hands NaN back as null
    sums = counted.withColumn("y", F.coalesce("y", F.lit(float("nan")))).groupBy("feature", "rep", "y")
    rows = sums.applyInPandas(total, "feature int, rep int, y double, p double, n bigint")
    name = F.coalesce(F.get(F.array(*[F.lit(f) for f in features]), F.when(F.col("feature") >= 0, F.col("feature"))), F.lit(""))
    return rows.select(name.alias("feature"), "rep", F.when(~F.isnan("y"), F.col("y")).cast(kind).alias(y), "p", "n")


def model_permutation_importance(
    df: DataFrame, id_col: str, features: Sequence[str], y: str, score: Callable[[DataFrame], DataFrame],
    repeats: int = 10, seed: int = 42, threshold: float = 0.5,
) -> DataFrame:
    """feature, importance_mean and importance_std (drop of ROC AUC), accuracy_drop_mean and
    accuracy_drop_std, for a model that scores DataFrames: score(df with `vec`) adds `score`.

    Every variant of every row (`permutation_variants`) goes through one call of the
    scorer, so a fitted model scores one batch of rows x (features x repeats + 1) in one
    scan; equal scores of a (feature, repeat) and class are one counted row before they are
    kept, and both metrics are computed from these. A row is right when
    (score >= threshold) equals y. A scorer that knows the scores of all cells counts the
    same variants by cell numbers (`counted_variants`)."""
    if hasattr(score, "by_code"):
        scored = checkpoint(counted_variants(df, id_col, features, y, score, repeats, seed))
    else:
        v = permutation_variants(df, id_col, features, y, repeats, seed)
        scored = score(v).select("feature", "rep", y, F.col("score").cast("double").alias("p"))
        scored = checkpoint(scored.groupBy("feature", "rep", y, "p").agg(F.count(F.lit(1)).alias("n")))
    auc = ranking_scores(scored, y, "p", ["feature", "rep"], "n").select("feature", "rep", "roc_auc")
    right = (F.col("p") >= threshold).cast("int") == F.col(y).cast("int")
    known = F.sum(F.when(right.isNotNull(), F.col("n")))
    acc = scored.groupBy("feature", "rep").agg((F.sum(F.when(right, F.col("n")).when(~right, F.lit(0))) / known).alias("accuracy"))
    m = auc.join(acc, ["feature", "rep"])
    whole = Window.partitionBy()  # over features x repeats + 1 rows
    m = m.withColumns({f"base_{c}": F.max(F.when(F.col("rep") == 0, F.col(c))).over(whole) for c in ("roc_auc", "accuracy")}).filter("rep > 0")
    return m.groupBy("feature").agg(
        F.avg(F.col("base_roc_auc") - F.col("roc_auc")).alias("importance_mean"),
        F.stddev_pop(F.col("base_roc_auc") - F.col("roc_auc")).alias("importance_std"),
        F.avg(F.col("base_accuracy") - F.col("accuracy")).alias("accuracy_drop_mean"),
        F.stddev_pop(F.col("base_accuracy") - F.col("accuracy")).alias("accuracy_drop_std"),
    )


# ------------------------------------------------------------------ backgrounds
def newest_inputs(df: DataFrame, order: Sequence[Column], n: int = 512) -> DataFrame:
    """The newest n inputs: a top-n merge."""
    return df.orderBy(*order).limit(n)


def jittered_background(sample: DataFrame, id_col: str, features: Sequence[str], relative: float = 0.1, floor: float = 0.05, seed: int = 123) -> DataFrame:
    """Sampled inputs with noise of standard deviation max(relative * |x|, floor)."""
    return sample.select(
        id_col,
        *[
            (F.col(f) + F.greatest(F.abs(F.col(f)) * relative, F.lit(floor)) * seeded_normal(f"{f}|{seed}", id_col)).alias(f)
            for f in features
        ],
    )


def noise_background(rows: DataFrame, id_col: str, features: Sequence[str], n: int = 160, scale: float = 0.25, floor: float = 0.1, seed: int = 42) -> DataFrame:
    """n synthetic rows around each input: deviation max(scale * |x|, floor)."""
    long = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return long.select(
        id_col, "draw",
        *[
            (F.col(f) + F.greatest(F.abs(F.col(f)) * scale, F.lit(floor)) * seeded_normal(f"{f}|{seed}", id_col, "draw")).alias(f)
            for f in features
        ],
    )


# ------------------------------------------------------------------------- LIME
def local_surrogates(
    df: DataFrame, id_col: str, features: Sequence[str], score: Scorer, n_samples: int = 200, kernel_width: float | None = None,
    ridge: float = 1.0, seed: int = 42, top: int = 10, spread: Mapping[str, float] | None = None,
) -> DataFrame:
    """row_id, feature, weight, rank, intercept, fit (weighted R2): a weighted ridge
    line through perturbed copies of each row, in units of the feature spread.

    Perturbing, scoring and the weighted moments are native and fold before the
    shuffle; only the small d x d systems are solved in Arrow batches."""
    d = len(features)
    width = kernel_width or 0.75 * d**0.5
    if spread is None:
        row = df.agg(*[F.stddev_pop(f).alias(f) for f in features]).first()  # one row
        spread = {f: float(row[f] or 1.0) or 1.0 for f in features}
    long = df.select(id_col, *features).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    # draw 0 is the row itself
    eps = {f: F.when(F.col("draw") == 0, F.lit(0.0)).otherwise(seeded_normal(f"{f}|{seed}", id_col, "draw")) for f in features}
    long = long.withColumns({f"__e{j}": eps[f] for j, f in enumerate(features)})
    x = {f: F.col(f) + F.col(f"__e{j}") * F.lit(spread[f]) for j, f in enumerate(features)}
    dist2 = sum((F.col(f"__e{j}") * F.col(f"__e{j}") for j in range(d)), F.lit(0.0))
    long = long.select(
        id_col, *[f"__e{j}" for j in range(d)], score(x).alias("__y"), F.sqrt(F.exp(-dist2 / F.lit(width * width))).alias("__w")
    )
    z = [F.lit(1.0)] + [F.col(f"__e{j}") for j in range(d)]
    w, yv = F.col("__w"), F.col("__y")
    moments = [F.sum(w * z[i] * z[j]).alias(f"m{i}_{j}") for i in range(d + 1) for j in range(i, d + 1)]
    moments += [F.sum(w * z[i] * yv).alias(f"v{i}") for i in range(d + 1)] + [F.sum(w * yv * yv).alias("yy")]
    sums = long.groupBy(id_col).agg(*moments)
    names = [c for c in sums.columns if c != id_col]

    def solve(frames):
        for f in frames:
            n = len(f)
            a, v = np.zeros((n, d + 1, d + 1)), np.zeros((n, d + 1))
            for i in range(d + 1):
                v[:, i] = f[f"v{i}"]
                for j in range(i, d + 1):
                    a[:, i, j] = a[:, j, i] = f[f"m{i}_{j}"]
            reg = np.diag([0.0] + [ridge] * d)
            beta = np.linalg.solve(a + reg, v[:, :, None])[:, :, 0] if n else v
            res = f["yy"].to_numpy() - 2 * (beta * v).sum(1) + np.einsum("ni,nij,nj->n", beta, a, beta)
            tot = f["yy"].to_numpy() - v[:, 0] ** 2 / a[:, 0, 0]
            fit = 1 - np.divide(res, tot, out=np.zeros(n), where=tot > 1e-15)
            yield pd.DataFrame({id_col: f[id_col], "beta": list(beta[:, 1:]), "intercept": beta[:, 0], "fit": fit})

    kind = dict(df.dtypes)[id_col]
    solved = sums.select(id_col, *names).mapInPandas(solve, f"`{id_col}` {kind}, beta array<double>, intercept double, fit double")
    cells = F.array(*[F.struct((-F.abs(F.col("beta")[j])).alias("m"), F.lit(j).alias("j"), F.lit(f).alias("feature"), F.col("beta")[j].alias("weight")) for j, f in enumerate(features)])
    ranked = solved.select(F.col(id_col).alias("row_id"), "intercept", "fit", F.posexplode(F.array_sort(cells)).alias("p", "c"))
    return ranked.filter(F.col("p") < top).select("row_id", "c.feature", "c.weight", (F.col("p") + 1).alias("rank"), "intercept", "fit")
