"""Imputation, scaling, encoding (I) and class balance (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.operators import balance as B
from cohortry.operators import preprocess as P
from cohortry.operators.knn import knn_impute
from cohortry.plans.catalog import query, table
from cohortry.plans.tables import HOLED_SQL, holed
from cohortry.session import scratch_dir

# train rows: even keys; statistics come from them only
TRAIN = "o_orderkey % 2 = 0"
MODE_SQL = "(SELECT {c} FROM holed WHERE {c} IS NOT NULL AND {w} GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "i01_impute_train_stats",
    f"""WITH {HOLED_SQL} SELECT o_orderkey, round(coalesce(cost, (SELECT quantile_cont(cost, 0.5) FROM holed WHERE {TRAIN})), 6) AS cost_median,
 round(coalesce(cost, (SELECT avg(cost) FROM holed WHERE {TRAIN})), 4) AS cost_mean, coalesce(status, {MODE_SQL.format(c='status', w=TRAIN)}) AS status,
 coalesce(nothing, 0)::int AS nothing FROM holed""",
    digits=6,
)
def i01(spark, d):
    h = holed(spark, d)
    train = h.filter(TRAIN)
    out = h.withColumns({"cost_median": F.col("cost"), "cost_mean": F.col("cost")})
    med = P.Imputer({"cost_median": P.fit_imputer(train, ["cost"], "median").fill["cost"]})
    mean = P.Imputer({"cost_mean": P.fit_imputer(train, ["cost"], "mean").fill["cost"]})
    mode = P.fit_imputer(train, ["status", "nothing"], "most_frequent")
    out = mode.transform(mean.transform(med.transform(out)))
    return out.select("o_orderkey", "cost_median", F.round("cost_mean", 4).alias("cost_mean"), "status", F.col("nothing").cast("int").alias("nothing"))


@query(
    "i02_impute_whole_frame",
    f"""WITH {HOLED_SQL} SELECT o_orderkey, round(coalesce(cost, (SELECT quantile_cont(cost, 0.5) FROM holed)), 6) AS cost,
 coalesce(status, {MODE_SQL.format(c='status', w='true')}) AS status, coalesce(nothing, 0)::int AS nothing FROM holed""",
)
def i02(spark, d):
    h = holed(spark, d)
    num = P.fit_imputer(h, ["cost", "nothing"], "median")
    cat = P.fit_imputer(h, ["status"], "most_frequent")
    return cat.transform(num.transform(h)).select("o_orderkey", "cost", "status", F.col("nothing").cast("int").alias("nothing"))


# three patient features with holes in different places
GAPS_SQL = """gaps AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 <> 0 THEN c_acctbal / 1000 END AS f1,
 CASE WHEN c_nationkey % 4 <> 1 THEN n_orders::double END AS f2, CASE WHEN c_custkey % 7 <> 2 THEN avg_price / 97531e0 END AS f3
 FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS avg_price FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


def gaps(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("avg_price")
    )
    c = table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_nationkey") % 3 != 0, F.col("c_acctbal") / 1000).alias("f1"),
        F.when(F.col("c_nationkey") % 4 != 1, F.col("n_orders").cast("double")).alias("f2"),
        F.when(F.col("c_custkey") % 7 != 2, F.col("avg_price") / 97531.0).alias("f3"),
    )


def _i03_fill(f: str) -> str:
    same = " + ".join(f"coalesce((a.{g} - b.{g}) * (a.{g} - b.{g}), 0)" for g in ("f1", "f2", "f3"))
    shared = " + ".join(f"(a.{g} IS NOT NULL AND b.{g} IS NOT NULL)::int" for g in ("f1", "f2", "f3"))
    return f"""SELECT id, avg(v) AS v FROM (SELECT a.id, b.{f} AS v, row_number() OVER (PARTITION BY a.id ORDER BY round(sqrt(({same}) * (3 / nullif({shared}, 0))), 12), b.id) AS r
 FROM gaps a JOIN gaps b ON a.{f} IS NULL AND b.{f} IS NOT NULL WHERE {shared} > 0) WHERE r <= 5 GROUP BY id"""


@query(
    "i03_knn_impute",
    f"""WITH {GAPS_SQL}, k1 AS ({_i03_fill('f1')}), k2 AS ({_i03_fill('f2')}), k3 AS ({_i03_fill('f3')})
 SELECT gaps.id, round(coalesce(f1, k1.v, (SELECT avg(f1) FROM gaps)), 6) AS f1, round(coalesce(f2, k2.v, (SELECT avg(f2) FROM gaps)), 6) AS f2,
 round(coalesce(f3, k3.v, (SELECT avg(f3) FROM gaps)), 6) AS f3 FROM gaps LEFT JOIN k1 ON k1.id = gaps.id LEFT JOIN k2 ON k2.id = gaps.id LEFT JOIN k3 ON k3.id = gaps.id""",
)
def i03(spark, d):
    return knn_impute(gaps(spark, d), "id", ["f1", "f2", "f3"], 5)


NUM = ["l_quantity", "l_extendedprice", "l_discount"]


def scaled_sql(mid: str, wide: str) -> str:
    cols = ", ".join(
        f"round(({c} - (SELECT {mid.format(c=c)} FROM lineitem)) / (SELECT coalesce(nullif({wide.format(c=c)}, 0), 1) FROM lineitem), 6) AS {c}" for c in NUM
    )
    return f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {cols}, 0e0 AS constant FROM lineitem"


def _scaled(spark, d, method):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *NUM, F.lit(3.0).alias("constant"))
    return P.fit_scaler(li, [*NUM, "constant"], method).transform(li)


@query("i04_standard_scale", scaled_sql("avg({c})", "stddev_pop({c})"))
def i04(spark, d):
    return _scaled(spark, d, "standard")


@query("i05_minmax_scale", scaled_sql("min({c})", "max({c}) - min({c})"))
def i05(spark, d):
    return _scaled(spark, d, "minmax")


@query("i06_robust_scale", scaled_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def i06(spark, d):
    return _scaled(spark, d, "robust")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "i07_onehot",
    "SELECT o_orderkey, " + ", ".join(f"(o_orderpriority = '{p}')::int::double AS \"priority_{p}\"" for p in PRIORITIES[1:4]) + " FROM orders",
)
def i07(spark, d):
    """Categories fitted without the last priority, which then is unknown."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    return P.fit_onehot(o.filter(F.col("priority") != PRIORITIES[4]), ["priority"]).transform(o)


@query(
    "i08_ordinal",
    """WITH k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT p_name AS v FROM part WHERE p_partkey % 3 <> 0))
 SELECT p_partkey, coalesce(code, -1)::bigint AS code FROM part LEFT JOIN k ON v = p_name""",
)
def i08(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return P.apply_ordinal(p, "p_name", P.ordinal_codes(p.filter("p_partkey % 3 <> 0"), "p_name"), "code").select("p_partkey", "code")


@query(
    "i09_combined_dummies",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'test' END AS part, " + ", ".join(f"(o_orderpriority = '{p}')::int::double AS \"priority_{p}\"" for p in PRIORITIES[1:]) + " FROM orders",
)
def i09(spark, d):
    """Each part lacks a category the other has."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    train, test = P.combined_dummies(o.filter(TRAIN), o.filter("NOT " + TRAIN), ["priority"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


PREP_SQL = f"""{HOLED_SQL}, tr AS (SELECT * FROM holed WHERE {TRAIN}), im AS (SELECT o_orderkey, coalesce(cost, (SELECT quantile_cont(cost, 0.5) FROM tr)) AS cost, priority FROM holed),
 st AS (SELECT avg(cost) AS m, stddev_pop(cost) AS s FROM im WHERE {TRAIN})"""
PREP_SELECT = "round((cost - m) / s, 6) AS cost, " + ", ".join(f"(priority = '{p}')::int::double AS \"priority_{p}\"" for p in PRIORITIES[1:])


def _prep(spark, d):
    h = holed(spark, d).select("o_orderkey", "cost", "priority")
    return P.Preprocessor().fit(h.filter(TRAIN), ["o_orderkey"]), h


@query("i10_column_preprocess", f"WITH {PREP_SQL} SELECT o_orderkey, {PREP_SELECT} FROM im, st")
def i10(spark, d):
    pre, h = _prep(spark, d)
    return pre.transform(h)


@query(
    "i11_preprocess_info",
    "SELECT k.*, n.n AS n_train_rows FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey % 2 = 0) n, "
    "(VALUES ('cost', 'numeric', 'median', 'standard', 1), ('priority', 'categorical', 'most_frequent', 'onehot', 4), ('o_orderkey', 'passthrough', 'none', 'none', 1)) "
    'k("column", kind, imputation, step, n_outputs)',
)
def i11(spark, d):
    pre, h = _prep(spark, d)
    n = h.filter(TRAIN).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return pre.info(spark).withColumn("n_train_rows", F.lit(n))


@query("i12_inverse_transform", f"WITH {PREP_SQL} SELECT o_orderkey, round(cost, 4) AS cost, priority FROM im", digits=4)
def i12(spark, d):
    pre, h = _prep(spark, d)
    return pre.inverse(pre.transform(h))


@query("i13_persisted_preprocess", f"WITH {PREP_SQL} SELECT o_orderkey, {PREP_SELECT} FROM im, st")
def i13(spark, d):
    pre, h = _prep(spark, d)
    path = scratch_dir(spark)
    pre.save(spark, path)
    return P.Preprocessor.load(spark, path).transform(h)


@query(
    "b01_imbalance_ratio",
    "WITH c AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS y, count(*) AS n FROM orders GROUP BY 1) SELECT CASE WHEN max(n) / min(n) >= 3 THEN 'balanced' END AS class_weight, round(max(n) / min(n), 6) AS ratio FROM c",
)
def b01(spark, d):
    return B.imbalance(table(spark, d, "orders").select(F.when(F.col("o_custkey") % 10 == 0, 1).otherwise(0).alias("y")), "y")


@query(
    "b02_balanced_weights",
    """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT o_orderpriority, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM c)
 SELECT o_orderkey, o.o_orderpriority, round(weight, 6) AS weight FROM orders o JOIN w ON w.o_orderpriority = o.o_orderpriority""",
)
def b02(spark, d):
    return B.with_weights(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


SMOTE_SQL = """p AS (SELECT c_custkey AS id, c_mktsegment AS y, c_acctbal / 1000 AS f1, coalesce(n_orders, 0)::double AS f2, coalesce(avg_price, 0) / 1e5 AS f3
 FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS avg_price FROM orders GROUP BY 1) ON o_custkey = c_custkey),
 c AS (SELECT y, count(*) AS n FROM p GROUP BY 1), m AS (SELECT max(n) AS most, least(5, greatest(min(n) - 1, 1)) AS k FROM c),
 hashed AS (SELECT p.*, n, most - n AS want, least(k, n - 1) AS k, ('0x' || substr(md5(concat_ws('|', id, '42')), 1, 8))::bigint AS h FROM p JOIN c ON c.y = p.y, m WHERE n < most),
 r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, id) AS r FROM hashed),
 b AS (SELECT *, unnest(range(1, (want // n + (r <= want % n)::int + 1)::bigint)) AS copy FROM r),
 b2 AS (SELECT *, (('0x' || substr(md5(concat_ws('|', id, copy, 'n42')), 1, 8))::bigint % greatest(k, 1) + 1) AS pick,
 (('0x' || substr(md5(concat_ws('|', id, copy, 'u42')), 1, 8))::bigint + 0.5e0) / 4294967296e0 AS u FROM b),
 nn AS (SELECT q.id, c.id AS nid, c.f1, c.f2, c.f3, row_number() OVER (PARTITION BY q.id ORDER BY round(sqrt((q.f1 - c.f1) * (q.f1 - c.f1) + (q.f2 - c.f2) * (q.f2 - c.f2) + (q.f3 - c.f3) * (q.f3 - c.f3)), 12), c.id) AS rk
 FROM hashed q JOIN hashed c ON c.y = q.y AND c.id <> q.id)"""


@query(
    "b03_smote",
    f"""WITH {SMOTE_SQL} SELECT y, b2.id, copy::int AS copy, nid AS neighbour, round(b2.f1 + u * (nn.f1 - b2.f1), 6) AS f1, round(b2.f2 + u * (nn.f2 - b2.f2), 6) AS f2,
 round(b2.f3 + u * (nn.f3 - b2.f3), 6) AS f3 FROM b2 JOIN nn ON nn.id = b2.id AND nn.rk = pick""",
)
def b03(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("avg_price"))
    c = table(spark, d, "customer")
    p = c.join(o, c.c_custkey == o.o_custkey, "left").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("y"),
        F.array(
            F.col("c_acctbal") / 1000, F.coalesce(F.col("n_orders"), F.lit(0)).cast("double"), F.coalesce(F.col("avg_price"), F.lit(0.0)) / 1e5
        ).alias("vec"),
    )
    s = B.smote(p, "id", "vec", "y")
    return s.select("y", "id", "copy", "neighbour", *[F.element_at("vec", i).alias(f"f{i}") for i in (1, 2, 3)])
