"""Orders as a scored table: fixed logistic scorecards over four features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.plans.catalog import table

FEATURES = ["x1", "x2", "x3", "x4"]
# intercept and weights of three scorecards
CARDS = {
    "a": (-1.2, [0.3, 0.15, -0.1, 0.2]),
    "b": (0.4, [-0.25, 0.1, 0.05, -0.3]),
    "c": (-0.3, [0.1, -0.2, 0.15, 0.1]),
}

BASE_SQL = """base AS (SELECT o_orderkey AS id, o_orderpriority, o_totalprice, o_orderstatus, (o_orderstatus = 'F')::int AS y,
 o_totalprice / 1e5 AS x1, substr(o_orderpriority, 1, 1)::double AS x2, (year(o_orderdate) - 1992)::double AS x3, day(o_orderdate) / 10e0 AS x4 FROM orders)"""


def z_sql(card: str, x: list[str] | None = None) -> str:
    b, w = CARDS[card]
    return f"({b}::double " + " ".join(f"+ {wi}::double * {xi}" for wi, xi in zip(w, x or FEATURES)) + ")"


def p_sql(card: str, x: list[str] | None = None, digits: int | None = 6) -> str:
    p = f"1e0 / (1e0 + exp(-{z_sql(card, x)}))"
    return f"round({p}, {digits})" if digits else f"({p})"


SCORED_SQL = f"{BASE_SQL}, scored AS (SELECT *, " + ", ".join(f"{p_sql(c)} AS p_{c}" for c in CARDS) + " FROM base)"


def base(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), "o_orderpriority", "o_totalprice", "o_orderstatus",
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        (F.col("o_totalprice") / 1e5).alias("x1"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("x2"),
        (F.year("o_orderdate") - 1992).cast("double").alias("x3"),
        (F.dayofmonth("o_orderdate") / 10.0).alias("x4"),
    )


def z(card: str, x: dict[str, Column] | None = None) -> Column:
    b, w = CARDS[card]
    out = F.lit(b)
    for wi, f in zip(w, FEATURES):
        out = out + F.lit(wi) * (x[f] if x else F.col(f))
    return out


def p(card: str, x: dict[str, Column] | None = None, digits: int | None = 6) -> Column:
    out = F.lit(1.0) / (F.lit(1.0) + F.exp(-z(card, x)))
    return F.round(out, digits) if digits else out


def scored(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).withColumns({f"p_{c}": p(c) for c in CARDS})


def long_scored(spark: SparkSession, d: str) -> DataFrame:
    """model, id, y, p for the three scorecards."""
    cells = F.array(*[F.struct(F.lit(c).alias("model"), F.col(f"p_{c}").alias("p")) for c in CARDS])
    return scored(spark, d).select("id", "y", "o_orderpriority", "o_totalprice", F.explode(cells).alias("m")).select(
        "id", "y", "o_orderpriority", "o_totalprice", "m.model", "m.p"
    )


LONG_SQL = SCORED_SQL + ", long AS (" + " UNION ALL ".join(
    f"SELECT id, y, o_orderpriority, o_totalprice, '{c}' AS model, p_{c} AS p FROM scored" for c in CARDS
) + ")"
