"""Class imbalance: ratio, weights and synthetic minority rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.seeded import seeded_hash, seeded_uniform
from cohortry.operators.knn import BLOCK_ROWS, euclidean, nearest
from cohortry.operators.ranks import global_rank, null_safe_join, small_side
from cohortry.operators.splits import rank_thresholds
from cohortry.session import checkpoint


def class_counts(df: DataFrame, y: str) -> DataFrame:
    return df.filter(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))


def imbalance(df: DataFrame, y: str, threshold: float = 3.0) -> DataFrame:
    """class_weight (balanced or null) and the ratio of the largest to the smallest class."""
    c = class_counts(df, y).agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.count(F.lit(1)).alias("k"))
    ratio = F.when(F.col("k") < 2, F.lit(1.0)).otherwise(F.col("hi") / F.col("lo"))
    return c.select(
        F.when((F.col("k") >= 2) & (ratio >= threshold), F.lit("balanced")).alias("class_weight"), ratio.alias("ratio")
    )


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """weight = n / (classes * n_class), one row per class."""
    c = checkpoint(class_counts(df, y))
    whole = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k")).first()
    return c.select(y, "n", (F.lit(whole["n"]) / (F.lit(whole["k"]) * F.col("n"))).alias("weight"))


def with_weights(df: DataFrame, y: str, out: str = "weight") -> DataFrame:
    """Weight column for learners that take one; rows without a label weigh 1."""
    side = small_side(class_weights(df, y).select(F.col(y).alias("__y"), F.col("weight").alias("__w")))
    return df.join(side, F.col(y) == F.col("__y"), "left").withColumn(out, F.coalesce("__w", F.lit(1.0))).drop("__y", "__w")


def smote(
    df: DataFrame, id_col: str, vec: str, y: str, k: int = 5, seed: int = 42, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Synthetic rows that raise every class to the size of the largest.

    Returns y, base id, copy number, neighbour id and the new vector. The new rows
    of a class are spread evenly over its base rows, the remainder goes to the first
    ones by seeded hash; neighbour and step are seeded as well. Only classes below
    the largest are searched, each inside itself."""
    rows = df.filter(F.col(y).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).alias("vec"), F.col(y).alias("y"))
    counts = checkpoint(class_counts(rows, "y"))
    most, least = counts.agg(F.max("n"), F.min("n")).first()
    if most is None:
        raise ValueError("no labelled rows")
    k = min(k, max(least - 1, 1))
    missing = F.lit(most) - F.col("n")
    small = global_rank(counts.filter(F.col("n") < most), ["y"], out="grp").select(
        "y", F.col("grp").cast("int").alias("grp"), F.floor(missing / F.col("n")).cast("bigint").alias("__reps"),
        (missing % F.col("n")).alias("__extra"), F.least(F.lit(k), F.col("n") - 1).cast("int").alias("__k"),
    )
    small = small_side(small)
    base = rows.join(small, "y").withColumn("h", seeded_hash(str(seed), "id"))
    # the remainder: one threshold per class
    th = rank_thresholds(base, "h", ["id"], lambda n: [F.col("__extra")], ["grp", "__extra"]).drop("__extra")
    th = small_side(th)
    base = null_safe_join(base, th, ["grp"], "left")
    more = F.coalesce(F.struct("h", "id") <= F.col("t0"), F.lit(False)).cast("int")
    base = base.withColumn("__n", F.col("__reps") + more).filter("__n > 0")
    copies = base.select(
        "y", "id", "vec", "__k", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("copy")
    )
    pick = F.when(F.col("__k") > 0, F.pmod(seeded_hash(f"n{seed}", "id", "copy"), F.greatest("__k", F.lit(1))) + 1)
    copies = copies.withColumns({"rank": pick.cast("int"), "u": seeded_uniform(f"u{seed}", "id", "copy")})
    members = rows.join(small.select("y", "grp"), "y")
    # only rows that are copied need neighbours
    asking = members.join(base.select("id").distinct(), "id", "left_semi")
    near = nearest(
        asking.select(F.col("id").alias("qid"), "vec", "grp"), members.select(F.col("id").alias("cid"), "vec", "grp"), k,
        euclidean(), block_rows=block_rows,
    )
    nb = near.join(members.select(F.col("id").alias("cid"), F.col("vec").alias("nvec")), "cid").select(
        F.col("qid").alias("id"), "rank", F.col("cid").alias("neighbour"), "nvec"
    )
    out = copies.join(nb, ["id", "rank"], "left")
    step = F.zip_with("vec", F.coalesce("nvec", "vec"), lambda a, b: a + F.col("u") * (b - a))
    return out.select(F.col("y").alias(y), F.col("id").alias(id_col), "copy", "neighbour", step.alias(vec))
