"""Splits, folds, samples and top-k (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.operators import splits as S
from cohortry.plans.catalog import query, table


def h(cols: str, seed: str = "42") -> str:
    return f"('0x' || substr(md5(concat_ws('|', {cols}, '{seed}')), 1, 8))::bigint"


def split_sql(source: str, key: str, strat: str, test: float, val: float) -> str:
    """Ranked by hash inside the stratum; boundaries rounded half up."""
    nt = f"floor(n * {test}::double + 0.5)"
    cut2 = f"{nt} + floor((n - {nt}) * {val / (1 - test)!r}::double + 0.5)"
    mid = f"WHEN r <= {cut2} THEN 'validation'" if val else ""
    return f"""SELECT {key}, CASE WHEN r <= {nt} THEN 'test' {mid} ELSE 'train' END AS split FROM (
 SELECT {key}, row_number() OVER (PARTITION BY {strat} ORDER BY {h(key)}, {key}) AS r, count(*) OVER (PARTITION BY {strat}) AS n FROM {source})"""


@query("w01_stratified_split", split_sql("orders", "o_orderkey", "o_orderstatus", 0.2, 0.2))
def w01(spark, d):
    return S.split(table(spark, d, "orders"), ["o_orderkey"], "o_orderstatus").select("o_orderkey", "split")


@query("w01_plain_split", split_sql("orders", "o_orderkey", "1", 0.25, 0))
def w01b(spark, d):
    return S.split(table(spark, d, "orders"), ["o_orderkey"], test=0.25, validation=0).select("o_orderkey", "split")


# the first customer forms a class of its own, so the split falls back to plain
@query("w02_safe_split", split_sql("customer", "c_custkey", "1", 0.2, 0))
def w02(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") == 0, "rare").otherwise(F.col("c_mktsegment")).alias("target"))
    return S.safe_split(c, ["c_custkey"], "target").select("c_custkey", "split")


@query(
    "w04_kfold",
    f"""SELECT o_orderkey, CASE {" ".join(f"WHEN r <= (n // 5) * {i} + least(n % 5, {i}) THEN {i - 1}" for i in range(1, 5))} ELSE 4 END AS fold FROM (
 SELECT o_orderkey, row_number() OVER (ORDER BY {h('o_orderkey')}, o_orderkey) AS r, count(*) OVER () AS n FROM orders)""",
)
def w04(spark, d):
    return S.kfold(table(spark, d, "orders"), ["o_orderkey"], 5).select("o_orderkey", "fold")


@query("w07_top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def w07(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("w08_fixed_sample", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {h('o_orderkey')}, o_orderkey LIMIT 100")
def w08(spark, d):
    return S.sample_rows(table(spark, d, "orders"), ["o_orderkey"], 100).select("o_orderkey", "o_totalprice")


@query(
    "s14_null_injection",
    f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY {h('o_orderkey', 'o_totalprice|42')}, o_orderkey) AS rp,
 row_number() OVER (ORDER BY {h('o_orderkey', 'o_orderpriority|42')}, o_orderkey) AS rq, count(*) OVER () AS n FROM orders)
 SELECT o_orderkey, CASE WHEN rp > floor(n * 0.05::double) THEN o_totalprice END AS o_totalprice,
 CASE WHEN rq > floor(n * 0.05::double) THEN o_orderpriority END AS o_orderpriority FROM r""",
)
def s14(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return S.inject_nulls(o, ["o_orderkey"], ["o_totalprice", "o_orderpriority"], 0.05)
