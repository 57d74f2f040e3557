import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortry.operators import metrics as M
from cohortry.operators import splits as S
from cohortry.operators.ranks import double_code, exact_quantiles, global_rank, running_totals
from cohortry.operators.sequence import sequential_id

floats = st.floats(-1e9, 1e9, allow_nan=False)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(floats, min_size=1, max_size=40))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.9, 1.0]).first()
    want = np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0])
    assert np.allclose([got[f"q{i}"] for i in range(5)], want, rtol=1e-9, atol=1e-9)


def test_quantiles_by_key_with_nulls(spark):
    rows = [("a", 1.0), ("a", None), ("a", 3.0), (None, 5.0), (None, -5.0), ("z", None)]
    got = {r["k"]: r["q0"] for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["v"], [0.5], ["k"]).collect()}
    assert got == {"a": 2.0, None: 0.0}


def test_bucket_is_monotone(spark):
    rng = np.random.default_rng(0)
    x = np.sort(np.r_[rng.normal(0, 1e6, 500), rng.normal(0, 1e-6, 500), 0.0, -0.0, -np.inf, np.inf, 5e-324, -1e308, 1e308, 2.0**-1022, *(2.0 ** np.arange(-60, 60)), *(2.0 ** np.arange(-60, 60) * (1 - 2**-53))])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double")
    b = [r[0] for r in df.orderBy("i").select(double_code(F.col("v"))).collect()]
    assert b == sorted(b)


def test_quantiles_of_values_close_together(spark):
    """Epoch seconds, and values that differ in the last bits only."""
    base = 1.7e9
    v = np.r_[base + np.arange(1000) * 7 % 911, [base + k * 2.0**-22 for k in range(50)]]
    w = np.r_[1 - np.arange(1000) * 1e-9, np.full(50, 1.0)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(v, w, strict=True)], "v double, w double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    for r in exact_quantiles(df, ["v", "w"], probs).collect():
        want = np.quantile({"v": v, "w": w}[r["feature"]], probs)
        assert np.allclose([r[f"q{i}"] for i in range(len(probs))], want, rtol=1e-15)


def test_codes_tell_close_values_apart(spark):
    """The buckets of the second pass hold few values where the first has one bucket."""
    df = spark.range(100_000).select((F.col("id") + 1.7e9).alias("v")).withColumn("c", double_code(F.col("v")))
    assert df.select(F.shiftright("c", 21)).distinct().count() <= 2
    assert df.groupBy("c").count().agg(F.max("count")).first()[0] == 1


def _largest_share(df, part):
    n = [r["count"] for r in df.groupBy(part).count().collect()]
    return max(n) / sum(n)


def test_crowded_axes_are_spread(spark):
    """Rare-event scores, a common prefix and one large key: ranks are right, and range
    partitions share the rows."""
    df = spark.range(4000).select(
        F.concat(F.lit("Customer#000"), F.format_string("%06d", "id")).alias("t"),
        F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise("k").alias("k"), (1 - F.col("id") / 1e9).alias("p"),
    )
    ranked = global_rank(df, ["t"])
    assert [r["rank"] for r in ranked.orderBy("t").collect()] == list(range(1, 4001))
    assert _largest_share(df.repartitionByRange(8, "t"), F.spark_partition_id()) < 0.5
    per = global_rank(df, ["p"], ["k"]).orderBy("k", "p").select("k", "rank").collect()
    assert [r["rank"] for r in per] == [*range(1, 801), *range(1, 3201)]
    run = running_totals(df.withColumn("n", F.lit(1)), "p", ["n"], ["k"], descending=True).orderBy("k", F.desc("p")).collect()
    assert [r["cum_n"] for r in run] == [*range(1, 801), *range(1, 3201)] and {r["tot_n"] for r in run} == {800, 3200}


def test_ranks_of_nothing(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert global_rank(none, ["v"], ["k"]).count() == 0 and exact_quantiles(none, ["v"], [0.5]).count() == 0
    assert running_totals(none.withColumn("n", F.lit(1)), "v", ["n"]).count() == 0


def test_auc_ties_single_class_and_bounds(spark):
    rows = [("m", 1, 0.0), ("m", 0, 0.5), ("m", 1, 0.5), ("m", 0, 1.0), ("m", 1, 1.0), ("one", 1, 0.3)]
    got = {r["k"]: r for r in M.ranking_scores(spark.createDataFrame(rows, "k string, y int, p double"), "y", "p", ["k"]).collect()}
    pairs = [(a, b) for a in (0.0, 0.5, 1.0) for b in (0.5, 1.0)]
    want = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs])
    assert got["m"]["roc_auc"] == pytest.approx(want)
    assert got["one"]["roc_auc"] is None and got["one"]["n"] == 1


def test_calibration_edges(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.0), (1, 1.0), (1, 0.95)], "y int, p double")
    bins = {r["bin"]: r["n"] for r in M.calibration_curve(df, "y", "p").collect()}
    assert bins == {0: 2, 9: 2}  # right-closed: 0.1 falls into the first bin
    ece = M.expected_calibration_error(df, "y", "p").first()["ece"]
    # left-closed: 0.1 in its own bin, 1.0 in none, n = 4
    assert ece == pytest.approx((abs(0 - 0.0) + abs(1 - 0.1) + abs(1 - 0.95)) / 4)


def test_split_shares_and_determinism(spark):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") % 10 == 0, 1).otherwise(0))
    a = S.split(df, ["id"], "y").groupBy("y", "split").count().collect()
    counts = {(r["y"], r["split"]): r["count"] for r in a}
    assert counts == {(0, "test"): 180, (0, "validation"): 180, (0, "train"): 540, (1, "test"): 20, (1, "validation"): 20, (1, "train"): 60}
    again = S.split(df.repartition(7), ["id"], "y").filter("split = 'test'").select("id").collect()
    first = S.split(df, ["id"], "y").filter("split = 'test'").select("id").collect()
    assert sorted(r[0] for r in again) == sorted(r[0] for r in first)


def test_split_edges(spark):
    assert S.split(spark.range(0), ["id"]).count() == 0
    assert [r["split"] for r in S.split(spark.range(1), ["id"]).collect()] == ["train"]
    with pytest.raises(ValueError):
        S.split(spark.range(3), ["id"], test=0.7, validation=0.4)


def test_kfold_sizes(spark):
    sizes = sorted(r["count"] for r in S.kfold(spark.range(13), ["id"], 5).groupBy("fold").count().collect())
    assert sizes == [2, 2, 3, 3, 3]


def test_sequential_id(spark):
    df = spark.createDataFrame([(5,), (1,), (5,), (9,)], "v long").withColumn("t", F.monotonically_increasing_id())
    got = [r["id"] for r in sequential_id(df, ["v", "t"]).orderBy("v", "t").collect()]
    assert got == [1, 2, 3, 4]


def test_null_injection_is_exact(spark):
    df = spark.range(200).withColumn("v", F.lit(1.0))
    assert S.inject_nulls(df, ["id"], ["v"], 0.05).filter("v IS NULL").count() == 10


def test_strata_are_not_shuffled_on(spark):
    """Labelling rows by stratum needs no exchange of the rows on the stratum."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(2000).withColumn("y", F.col("id") % 3)
        out = S.split(df, ["id"], "y")
        assert "Exchange hashpartitioning(y" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.count() == 2000


def test_thresholds_with_equal_hashes(spark):
    """Rows that share a hash are told apart by their ids."""
    df = spark.range(90).select("id", (F.col("id") % 3).cast("bigint").alias("h"))
    got = S.rank_thresholds(df, "h", ["id"], lambda n: [n * 0, n * 0 + 1, n / 2, n]).first()
    ranked = sorted((r["h"], r["id"]) for r in df.collect())
    assert got["t0"] is None
    assert [tuple(got[f"t{i}"]) for i in (1, 2, 3)] == [ranked[0], ranked[44], ranked[89]]
