"""Numbering, filling and explaining leave nothing out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import explain as X
from cohortry.operators import ranks
from cohortry.operators.knn import knn_impute
from cohortry.sources.datasets import numbered


def test_numbers_after_a_shuffle(spark):
    """Every row comes back, numbered 1..n, when partitions are coalesced differently."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        left = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("patient"), F.repeat(F.lit("x"), 50).alias("wide"))
        right = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("patient"), F.col("id").alias("v"))
        rows = numbered(left.join(right.hint("merge"), "patient")).select("patient_id", "patient", "wide", "v").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r["patient_id"] for r in rows) == list(range(1, 20_001))
    assert len({r["patient"] for r in rows}) == 20_000
    assert numbered(left.limit(0)).count() == 0


def test_ranks_of_an_unstable_input(spark):
    """The input is evaluated once: a random column keeps the ranks whole."""
    df = spark.range(500).withColumn("a", F.rand())
    rows = ranks.global_rank(df, ["a"]).orderBy("a").collect()
    assert [r["rank"] for r in rows] == list(range(1, 501)) and len({r["id"] for r in rows}) == 500


def test_fills_of_large_ids(spark):
    big = 9007199254740993
    rows = [(big, 1.0, None), (big + 1, 1.1, 5.0), (big + 2, 50.0, 90.0), (big + 3, None, 20.0), (2**62, 49.0, None)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")
    got = {r["id"]: (r["a"], r["b"]) for r in knn_impute(df, "id", ["a", "b"], k=1).collect()}
    assert got[big] == (1.0, 5.0) and got[2**62] == (49.0, 90.0) and len(got) == 5


def test_permutations_meet_the_whole_background(spark):
    background = [(float(k), float(k % 7), 1.0) for k in range(100)]
    value = lambda v: v[0] * v[0] + v[1] * 2 + v[2] * v[1]
    df = spark.createDataFrame([(1, 10.0, 10.0, 10.0)], "id int, a double, b double, c double")
    for permutations in (None, 20):
        phi = X.model_contributions(df, "id", ["a", "b", "c"], background, lambda d: d.withColumn("score", value(F.col("vec"))), permutations, 1).first()["phi"]
        # contributions add up to the score minus the mean over all background rows
        assert sum(phi) == pytest.approx(value((10.0, 10.0, 10.0)) - np.mean([value(b) for b in background]))
        assert phi[0] == pytest.approx(100.0 - np.mean([b[0] ** 2 for b in background]))


def test_quantiles_of_odd_numbers(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, float("nan"), 100.0, None)], "v double")
    assert ranks.exact_quantiles(df, ["v"], [0.5]).first()["q0"] == 2.5
    df = spark.createDataFrame([(v,) for v in (float("-inf"), 2.0, 3.0, 4.0, float("inf"))], "v double")
    assert ranks.exact_quantiles(df, ["v"], [0.5]).first()["q0"] == 3.0
