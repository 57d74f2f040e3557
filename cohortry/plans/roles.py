"""The test tables in their clinical roles, as Spark views and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators.longitudinal import CodeCounts
from cohortry.plans.catalog import table

# orders are encounters; the last shipment of an order ends it
ENC_SQL = """enc AS (SELECT o_custkey AS patient, o_orderkey AS id, o_orderdate AS start_ts, s.stop_ts,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'emergency' ELSE o_orderpriority END AS cls, o_totalprice AS cost
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS stop_ts FROM lineitem GROUP BY 1) s ON s.l_orderkey = o_orderkey)"""
# shipped lines are conditions, returned ones medications; an open line has no stop
COND_SQL = """cond AS (SELECT o_custkey AS patient, l_partkey AS code, p_name AS description, o_orderdate AS start_ts,
  CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_shipdate END AS stop_ts, l_returnflag AS flag,
  l_orderkey AS ok, l_linenumber AS ln, l_suppkey AS sk
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey)"""
OBS_SQL = "obs AS (SELECT user_id AS patient, event_type AS code, ts, event_id AS id, CASE WHEN value < 1 THEN 'n/a' ELSE value::varchar END AS value FROM events)"

OBS_CODES = {c: c for c in ["view", "signup", "error", "click", "purchase"]}


CONDITION_COUNTS = [CodeCounts("n_conditions", "n_unique_condition_codes", "n_chronic_conditions")]
MEDICATION_COUNTS = [CodeCounts("n_medications", "n_unique_medication_codes", "n_active_medications", "flag = 'R'")]


def patients(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("patient"), "c_mktsegment", "c_acctbal", "c_nationkey"
    )


def encounters(spark: SparkSession, d: str) -> DataFrame:
    stops = (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.max("l_shipdate").alias("stop"))
    )
    return table(spark, d, "orders").join(stops, "o_orderkey", "left").select(
        F.col("o_custkey").alias("patient"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("start"),
        "stop",
        F.when(F.col("o_orderpriority") == "1-URGENT", "emergency")
        .otherwise(F.col("o_orderpriority"))
        .alias("class"),
        F.col("o_totalprice").alias("cost"),
    )


def conditions(spark: SparkSession, d: str) -> DataFrame:
    stop = F.when(F.col("l_linestatus") == "O", F.lit(None)).otherwise(F.col("l_shipdate"))
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", stop.alias("stop"), "l_returnflag", "l_linenumber", "l_suppkey"
    )
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    # parts first: lines then move beside lines of the same part, and later of the same
    # order, whose repeated values compress, and the order's columns move once less
    return (
        li.join(p, li.l_partkey == p.p_partkey, "left")
        .join(o, li.l_orderkey == o.o_orderkey)
        .select(
            F.col("o_custkey").alias("patient"),
            F.col("l_partkey").alias("code"),
            F.col("p_name").alias("description"),
            F.col("o_orderdate").alias("start"),
            "stop",
            F.col("l_returnflag").alias("flag"),
            F.col("l_orderkey").alias("ok"),
            F.col("l_linenumber").alias("ln"),
            F.col("l_suppkey").alias("sk"),
        )
    )


def medications(spark: SparkSession, d: str) -> DataFrame:
    return conditions(spark, d).filter(F.col("flag") == "R")


def observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("patient"),
        F.col("event_type").alias("code"),
        "ts",
        F.col("event_id").alias("id"),
        F.when(F.col("value") < 1, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
    )
