"""Lists and counts of one table in one pass, and joins that all parts of the build share."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortry.operators import longitudinal as L
from conftest import SMALL


def test_whole_build_moves_lines_once_per_join(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry.queries()["a00_longitudinal_patients"](spark, SMALL)
        assert len(df.collect()) == 150
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"[+:]- Exchange hashpartitioning\(l_(?:orderkey|partkey)#", plan)
    assert len(moved) == 3  # lines to parts, to orders, and the last shipment of each order


def lines(spark):
    rows = [(p, i % 7, f"d{i % 5}" if i % 4 else ("" if i % 8 else None), i // 3, "R" if i % 3 == 0 else "N" if i % 5 else None, None if i % 2 else i)
            for p in (1, 2, None) for i in range(23 if p != 2 else 4)] + [(3, None, "x", 0, "R", 1), (4, 1, None, 0, "R", 1)]
    return spark.createDataFrame(rows, "patient int, code int, description string, start int, flag string, stop int")


def test_lists_together_equal_lists_apart(spark):
    df = lines(spark)
    order = ["start", F.col("code").desc(), "description"]
    both = {r["patient"]: r for r in L.summary_lists(df, "description", order, {"c": None, "m": "flag = 'R'"}).collect()}
    for name, part in (("c", df), ("m", df.filter("flag = 'R'"))):
        want = {}
        rows = [r for r in part.collect() if r["description"]]
        for p in {r["patient"] for r in rows}:
            mine = sorted((r for r in rows if r["patient"] == p), key=lambda r: (r["start"], r["code"] is None, -(r["code"] or 0), r["description"]))
            want[p] = " | ".join(r["description"] for r in mine[:5]) + (f" | (+{len(mine) - 5} more)" if len(mine) > 5 else "")
        if name == "c":
            got = {r["patient"]: r["c"] for r in L.summary_list(part, "description", order, "c").collect()}
            assert {p: v for p, v in got.items() if p is not None} == {p: v for p, v in want.items() if p is not None}
        assert {p: r[name] for p, r in both.items() if p is not None and r[name] is not None} == {p: v for p, v in want.items() if p is not None}


def test_codes_counted_once(spark):
    df = lines(spark)
    got = L.code_features(df, [L.CodeCounts("n", "k", "o"), L.CodeCounts("mn", "mk", "mo", "flag = 'R'")]).collect()
    for r in got:
        for n, k, o, rows in (
            ("n", "k", "o", [x for x in df.collect() if x["patient"] == r["patient"]]),
            ("mn", "mk", "mo", [x for x in df.collect() if x["patient"] == r["patient"] and x["flag"] == "R"]),
        ):
            codes = {x["code"] for x in rows} - {None}
            want = (len(rows), len(codes), sum(x["stop"] is None for x in rows)) if rows else (None, None, None)
            assert (r[n], r[k], r[o]) == want
