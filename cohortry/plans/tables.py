"""Sources, sinks (S) and data quality (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.operators import quality as Q
from cohortry.operators import splits
from cohortry.operators.lookup import lookup
from cohortry.plans.catalog import query, table
from cohortry.plans.windows import split_sql
from cohortry.session import scratch_dir
from cohortry.sources import readers, sinks
from cohortry.sources.contracts import DatasetContract, load_dataset

# orders with holes: the driver tables themselves have no nulls
HOLED_SQL = """holed AS (SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN o_totalprice END AS cost,
 CASE WHEN o_orderstatus = 'F' THEN 'F' END AS status, o_orderpriority AS priority, CASE WHEN o_orderkey < 0 THEN 1 END AS nothing FROM orders)"""


def holed(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_totalprice") > 150000, F.col("o_totalprice")).alias("cost"),
        F.when(F.col("o_orderstatus") == "F", "F").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderkey") < 0, F.lit(1)).alias("nothing"),
    )


CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("s01_read_formats", "SELECT f.fmt, c.* FROM customer c, (VALUES ('csv'), ('json'), ('parquet')) f(fmt)")
def s01(spark, d):
    """The customer table written and read back in each format."""
    src = table(spark, d, "customer")
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = sinks.write_table(src, scratch_dir(spark) + "." + fmt, fmt)
        part = readers.read_table(spark, path, schema=CUSTOMER).select(F.lit(fmt).alias("fmt"), *src.columns)
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "s02_load_profile",
    f"""WITH {HOLED_SQL}, n AS (SELECT count(*) AS n FROM holed)
 SELECT 0 AS position, 'o_orderkey' AS "column", 'bigint' AS dtype, (SELECT n FROM n) AS n_rows, count(*) FILTER (WHERE o_orderkey IS NULL) AS n_null FROM holed
 UNION ALL SELECT 1, 'cost', 'double', (SELECT n FROM n), count(*) FILTER (WHERE cost IS NULL) FROM holed
 UNION ALL SELECT 2, 'status', 'string', (SELECT n FROM n), count(*) FILTER (WHERE status IS NULL) FROM holed
 UNION ALL SELECT 3, 'priority', 'string', (SELECT n FROM n), count(*) FILTER (WHERE priority IS NULL) FROM holed
 UNION ALL SELECT 4, 'nothing', 'int', (SELECT n FROM n), count(*) FILTER (WHERE nothing IS NULL) FROM holed""",
)
def s02(spark, d):
    return Q.load_profile(holed(spark, d))


@query(
    "s03_headerless_null_markers",
    "SELECT o_orderkey AS id, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS cost, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders",
)
def s03(spark, d):
    """Headerless text with two null markers, `?` and `NA`."""
    o = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice").cast("string")).otherwise("?"),
        F.when(F.col("o_orderstatus") == "P", "NA").otherwise(F.col("o_orderstatus")),
    )
    path = scratch_dir(spark)
    o.write.option("header", "false").csv(path)
    return readers.read_headerless(spark, path, "id bigint, cost double, status string", ("?", "NA"))


@query(
    "s04_tagged_splits",
    "SELECT o_orderkey, o_totalprice, o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS dataset_split FROM orders",
)
def s04(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    paths = {}
    for name, cond in {"test": F.col("o_orderkey") % 4 == 0, "train": F.col("o_orderkey") % 4 != 0}.items():
        paths[name] = scratch_dir(spark)
        o.filter(cond).write.option("sep", "\t").option("header", "true").csv(paths[name])
    return readers.read_splits(spark, paths, "o_orderkey bigint, o_totalprice double, o_orderpriority string")


@query("s05_site_union", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS o_totalprice, o_orderstatus AS site FROM orders")
def s05(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sites = {s: o.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in ("O", "P", "F", "none")}
    sites["F"] = sites["F"].drop("o_totalprice")
    sites["absent"] = None
    return readers.union_sites(sites)


@query(
    "s06_unnamed_parts",
    "SELECT p_partkey::varchar AS feature_0, p_size::varchar AS feature_1, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS feature_2, p_type AS target_raw FROM part",
)
def s06(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).otherwise("?"), "p_type")
    paths = []
    for i in range(3):
        paths.append(scratch_dir(spark))
        p.filter(F.col("p_partkey") % 3 == i).write.option("header", "false").csv(paths[-1])
    return readers.read_unnamed_parts(spark, paths)


@query("s07_labelled_file_tree", "SELECT p_type || '/' || b AS folder, lower(p_type) AS split, b AS lesion_label, lower(b) AS lesion_label_clean FROM (SELECT DISTINCT p_type, replace(p_brand, '#', '-') AS b FROM part)")
def s07(spark, d):
    """A tree split/label/file written from the part table; images by extension only."""
    root = scratch_dir(spark) + "_tree"
    p = table(spark, d, "part").select("p_type", F.regexp_replace("p_brand", "#", "-").alias("p_brand"), F.col("p_name").alias("value"))
    p.withColumnsRenamed({"p_type": "a", "p_brand": "b"}).write.partitionBy("a", "b").text(root)
    tree = readers.scan_labelled_files(spark, root, ("txt",))
    strip = lambda c: F.regexp_replace(c, "^[ab]=", "")
    return tree.select(
        strip(F.col("split")).alias("split"),
        strip(F.col("lesion_label")).alias("lesion_label"),
        F.concat(F.regexp_extract("image_path", "^a=([^/]*)/", 1), F.lit("/"), F.regexp_extract("image_path", "/b=([^/]*)/", 1)).alias("folder"),
    ).withColumn("lesion_label_clean", F.regexp_replace(F.lower("lesion_label"), " ", "_")).distinct()


@query(
    "s08_sectioned_lookup",
    """SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey = 3 OR c_nationkey % 4 = 0 THEN 'Unknown' ELSE n_name END AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def s08(spark, d):
    """A lookup text of two sections, rendered from the fixed nation and region
    tables, parsed and applied to all customers."""
    key = F.col("n_nationkey")
    nation = table(spark, d, "nation").select(
        F.lit("nation_id,description").alias("head"), key.cast("bigint").alias("k"),
        F.concat_ws(
            ",", F.when(key == 3, "NULL").otherwise(key.cast("string")),
            F.when(key % 4 == 0, F.lit("NULL")).otherwise(F.concat(F.lit('"'), "n_name", F.lit('"'))),
        ).alias("line"),
    )
    region = table(spark, d, "region").select(
        F.lit("region_id,description").alias("head"), F.col("r_regionkey").cast("bigint").alias("k"),
        F.concat_ws(",", F.col("r_regionkey").cast("string"), "r_name").alias("line"),
    )
    rows = F.array_sort(F.collect_list(F.struct("k", "line")))
    sections = nation.unionByName(region).groupBy("head").agg(
        F.concat(F.col("head"), F.lit("\n"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n")).alias("body")
    )
    text = sections.groupBy().agg(F.array_join(F.array_sort(F.collect_list("body")), "\n,\n").alias("value"))
    out = scratch_dir(spark)
    text.coalesce(1).write.text(out)
    codes = readers.read_sectioned_lookup(spark, out).filter(F.col("column") == "nation_id")
    side = codes.select(F.col("code").cast("int").alias("c_nationkey"), F.col("description").alias("nation"))
    return lookup(table(spark, d, "customer").select("c_custkey", "c_nationkey"), side, ["c_nationkey"], {"nation": F.lit("Unknown")})


PATIENT_CONTRACT = {
    "patients": DatasetContract("patients", "customer.parquet", "c_mktsegment", "tabular", ("c_custkey", "c_acctbal"), "c_custkey")
}


@query("s09_contract_load", split_sql("customer", "c_custkey", "c_mktsegment", 0.2, 0.2).replace(" AS split FROM", " AS split, true AS valid FROM", 1))
def s09(spark, d):
    got = load_dataset(spark, "patients", d, PATIENT_CONTRACT, additional_required=["c_custkey", "c_name"], split_ids=["c_custkey"])
    return got.data.select("c_custkey", "split", F.lit(got.validation.valid).alias("valid"))


@query("s10_write_formats", "SELECT f.fmt, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders, (VALUES ('csv'), ('json'), ('parquet')) f(fmt) GROUP BY 1", digits=2)
def s10(spark, d):
    src = table(spark, d, "orders")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = sinks.write_table(src, scratch_dir(spark), fmt)
        part = readers.read_table(spark, path, fmt, schema).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
        part = part.select(F.lit(fmt).alias("fmt"), "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


@query("s11_write_split_pair", split_sql("orders", "o_orderkey", "o_orderstatus", 0.2, 0).replace("SELECT o_orderkey,", "SELECT o_orderkey, o_orderstatus,").replace("(PARTITION BY o_orderstatus) AS n FROM", "(PARTITION BY o_orderstatus) AS n FROM"))
def s11(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    path = sinks.write_split(splits.split(o, ["o_orderkey"], "o_orderstatus", 0.2, 0), scratch_dir(spark))
    return spark.read.parquet(path)


@query(
    "s12_manifest",
    """SELECT 'customer' AS dataset, count(*) AS n_rows, 5 AS n_columns, 'c_mktsegment' AS target, 'classification' AS type, count(DISTINCT c_mktsegment) AS n_classes, 'patients' AS description FROM customer
 UNION ALL SELECT 'orders', count(*), 6, 'o_orderstatus', 'classification', count(DISTINCT o_orderstatus), 'encounters' FROM orders
 UNION ALL SELECT 'part', count(*), 6, 'unknown', 'unknown', NULL, 'No description' FROM part""",
)
def s12(spark, d):
    """The empty dataset drops out."""
    o = table(spark, d, "orders")
    return Q.manifest(
        {
            "customer": (table(spark, d, "customer"), {"target": "c_mktsegment", "type": "classification", "description": "patients"}),
            "orders": (o, {"target": "o_orderstatus", "type": "classification", "description": "encounters"}),
            "part": (table(spark, d, "part"), {}),
            "empty": (o.filter("o_orderkey < 0"), {"target": "o_orderstatus"}),
        }
    )


@query(
    "s13_inventory_rollup",
    """SELECT 'type' AS scope, p_type AS name, count(*) AS n, round(sum(p_retailprice), 2) AS total_size FROM part GROUP BY p_type
 UNION ALL SELECT 'location', p_brand, count(*), round(sum(p_retailprice), 2) FROM part GROUP BY p_brand
 UNION ALL SELECT 'total', 'all', count(*), round(sum(p_retailprice), 2) FROM part""",
    digits=2,
)
def s13(spark, d):
    return Q.inventory_rollup(table(spark, d, "part"), "p_type", "p_brand", "p_retailprice")


@query(
    "q01_validate",
    """SELECT 'orders' AS name, (count(*) > 0) AS valid, CASE WHEN count(*) > 0 THEN '' ELSE 'dataset is empty' END AS issues FROM orders
 UNION ALL SELECT 'missing', false, 'missing required columns: age, sex; target column not found: target' || CASE WHEN count(*) > 0 THEN '' ELSE '; dataset is empty' END FROM orders
 UNION ALL SELECT 'empty', false, 'dataset is empty' FROM (SELECT count(*) FROM orders)""",
)
def q01(spark, d):
    o = table(spark, d, "orders")
    rows = [
        Q.issue_rows(spark, "orders", Q.validate(o, ["o_orderkey"], "o_orderstatus")),
        Q.issue_rows(spark, "missing", Q.validate(o, ["age", "o_orderkey", "sex"], "target")),
        Q.issue_rows(spark, "empty", Q.validate(o.filter("o_orderkey < 0"), ["o_orderkey"], "o_orderstatus")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "q02_duplicate_rows",
    """SELECT coalesce(sum(n - 1), 0)::bigint AS duplicate_rows FROM (SELECT *, count(*) AS n
 FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1) GROUP BY ALL)""",
)
def q02(spark, d):
    t = table(spark, d, "lineitem")
    return Q.duplicate_rows(t.unionByName(t.filter("l_linenumber = 1")))


NULLS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS col, count(*) AS n_rows, count(*) - count({c}) AS n_null FROM holed" for c in ("o_orderkey", "cost", "status", "priority", "nothing")
)


@query("q03_null_counts", f'WITH {HOLED_SQL} SELECT col AS "column", n_null, round(n_null / n_rows, 6) AS null_share, n_null / n_rows > 0.5 AS warning FROM ({NULLS_SQL})')
def q03(spark, d):
    return Q.sparse_columns(holed(spark, d))


@query("q04_totals", "SELECT count(*) AS n_rows, 11 AS n_columns, 8 AS n_numeric, 2 AS n_categorical FROM lineitem")
def q04(spark, d):
    return Q.totals(table(spark, d, "lineitem"))


def describe_sql(cols, tab):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::double AS min,
 round(quantile_cont({c}::double, 0.25), 6) AS q25, round(quantile_cont({c}::double, 0.5), 6) AS q50, round(quantile_cont({c}::double, 0.75), 6) AS q75, max({c})::double AS max FROM {tab}"""
        for c in cols
    )


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("q05_describe_numeric", describe_sql(NUMBERS, "lineitem"))
def q05(spark, d):
    return Q.describe_numeric(table(spark, d, "lineitem"), NUMBERS)


CAT = ["l_returnflag", "l_linestatus"]


@query(
    "q06_describe_categorical",
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 2" for c, t in (("p_brand", "part"), ("p_type", "part"), ("p_name", "part")))
    + """), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS position, count(*) OVER (PARTITION BY feature) AS n_distinct,
 first_value(value) OVER (PARTITION BY feature ORDER BY n DESC, value) AS mode FROM c) SELECT * FROM r WHERE position <= 5""",
)
def q06(spark, d):
    return Q.describe_categorical(table(spark, d, "part"))


@query(
    "q07_column_audit",
    f"""WITH {HOLED_SQL} SELECT col AS "column", n_rows, n_null, round(n_null / n_rows, 4) AS null_share, n_null = n_rows AS all_null,
 round(n_null / n_rows, 4) > 0.4 AS over_threshold, false AS repeated_name FROM ({NULLS_SQL})""",
)
def q07(spark, d):
    return Q.audit_columns(holed(spark, d))


@query(
    "q08_target_distribution",
    """WITH c AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS value, count(*) AS n FROM orders GROUP BY 1)
 SELECT value, n, round(n / sum(n) OVER (), 6) AS share, round(max(n) OVER () / greatest(min(n) OVER (), 1), 4) AS imbalance_ratio, count(*) OVER () AS n_values,
 max(n) OVER () / greatest(min(n) OVER (), 1) >= 1.5 AS imbalance_warning FROM c""",
)
def q08(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("diagnosis"))
    return Q.target_distribution(o, warn_ratio=1.5)


@query(
    "q09_audit_summary",
    f"""WITH {HOLED_SQL}, a AS (SELECT CASE WHEN bool_or(n_null = n_rows) THEN 'schema_warning' ELSE 'ok' END AS status, sum(n_null) AS n_null FROM ({NULLS_SQL})
 UNION ALL SELECT 'ok', 0 FROM (SELECT count(*) FROM customer) UNION ALL SELECT 'empty', 0 FROM (SELECT count(*) FROM part))
 SELECT status, count(*) AS n_tables, sum(n_null)::bigint AS total_nulls FROM a GROUP BY status""",
)
def q09(spark, d):
    parts = [
        Q.audit_table(holed(spark, d), "holed"),
        Q.audit_table(table(spark, d, "customer"), "customer"),
        Q.audit_table(table(spark, d, "part").filter("p_partkey < 0"), "none"),
    ]
    return Q.audit_summary(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    "q10_feature_schema",
    """SELECT k.kind, k.name, count(*) AS n_rows FROM lineitem, (VALUES ('missing', 'age'), ('extra', 'l_tax')) k(kind, name) GROUP BY 1, 2""",
)
def q10(spark, d):
    """Differences between the columns of a table and the fitted features."""
    li = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax")
    diff = Q.schema_differences(li.columns, ["l_quantity", "age", "l_discount"])
    lines = [F.struct(F.lit(k).alias("kind"), F.lit(c).alias("name"), F.col("n_rows")) for k, cs in diff.items() for c in cs]
    return li.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(F.array(*lines)))


@query(
    "q11_align_features",
    f"WITH {HOLED_SQL} SELECT o_orderkey, coalesce(cost, 0) AS cost, 0e0 AS age, cost AS cost_lenient, NULL::double AS age_lenient FROM holed",
)
def q11(spark, d):
    h = holed(spark, d)
    strict = Q.align_features(h.select("o_orderkey", "cost", "status"), ["cost", "age"], 0.0, ["o_orderkey"])
    lenient = Q.align_features(h.select("o_orderkey", "cost"), ["cost", "age"], None, ["o_orderkey"]).withColumnsRenamed(
        {"cost": "cost_lenient", "age": "age_lenient"}
    )
    return strict.join(lenient, "o_orderkey")


@query("q12_dataset_check", f"WITH {HOLED_SQL} SELECT 'holed' AS name, max(n_rows) AS n_rows, count(*) AS n_columns, sum(n_null)::bigint AS n_null, true AS has_target FROM ({NULLS_SQL})")
def q12(spark, d):
    h = holed(spark, d)
    a = Q.audit_table(h, "holed")
    return a.select("name", "n_rows", "n_columns", "n_null", F.lit("status" in h.columns).alias("has_target"))


@query("q13_class_percentages", "SELECT o_orderstatus AS label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percentage FROM orders GROUP BY 1")
def q13(spark, d):
    return Q.class_percentages(table(spark, d, "orders"), "o_orderstatus")
