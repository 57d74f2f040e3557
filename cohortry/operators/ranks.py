"""Global ranks, cumulative sums and exact quantiles without a one-task sort.

Ranks and cumulative sums cut the ordered axis into range partitions, whose bounds
Spark samples from the data; what lies in lower partitions is a tiny table. Quantiles
narrow a radix down to the wanted ranks. A key that holds a third of all rows is spread
over as many partitions as its rows fill.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.session import checkpoint

HASH_SPACE = 4294967296  # hashes are 32-bit


def hash_bucket(h: Column, buckets: int) -> Column:
    """Equal slices of the 32-bit hash space; balanced because hashes are uniform."""
    return F.floor(h / F.lit(HASH_SPACE / buckets)).cast("int")


def double_code(x: Column) -> Column:
    """Monotone 43-bit code of any double: sign, exponent and the upper 31 bits of the
    mantissa. Zero is 0, infinities share the code of the largest double."""
    a = F.least(F.greatest(F.abs(x), F.lit(2.2250738585072014e-308)), F.lit(1.7976931348623157e308))
    e = F.floor(F.log2(a)).cast("int")
    return _code(x, e, a * F.pow(F.lit(2.0), -e))


def _code(x: Column, e: Column, m: Column) -> Column:
    # the logarithm may be off by one next to a power of two
    e, m = e + F.when(m < 1, -1).when(m >= 2, 1).otherwise(0), F.when(m < 1, m * 2).when(m >= 2, m / 2).otherwise(m)
    code = F.shiftleft((e + 1023).cast("bigint"), 31) + F.floor((m - 1) * F.lit(float(1 << 31))).cast("bigint")
    return F.when(x > 0, code).when(x < 0, -code).otherwise(F.lit(0).cast("bigint"))


def _with_code(df: DataFrame, v: str, out: str) -> DataFrame:
    """`double_code` of a column, in steps, so that no step is computed twice."""
    a = F.least(F.greatest(F.abs(v), F.lit(2.2250738585072014e-308)), F.lit(1.7976931348623157e308))
    df = df.withColumn("__a", a).withColumn("__e", F.floor(F.log2("__a")).cast("int"))
    df = df.withColumn("__m", F.col("__a") * F.pow(F.lit(2.0), -F.col("__e")))
    return df.withColumn(out, _code(F.col(v), F.col("__e"), F.col("__m"))).drop("__a", "__e", "__m")


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A side table of a join, kept and counted: broadcast up to `rows` rows, so that the
    other side is not shuffled on what may be a few keys; joined as it is beyond."""
    kept = checkpoint(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; right key columns are dropped."""
    if not keys:
        raise ValueError("keys must not be empty")
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"__r_{k}"), keys, right)
    cond = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    )
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def global_rank(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """1-based row number per key over `order`, ties to be broken by the caller.

    One distributed sort, whose range partitions follow the data; it is kept, so the
    input is evaluated once. A rank is the rows of the key in lower partitions plus the
    place inside the own one."""
    keys = list(keys)
    kept = checkpoint(df.orderBy(*keys, *order)).withColumn("__at", F.monotonically_increasing_id())
    kept = kept.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    by = keys + ["__part"]
    # one row per key and partition it lies in
    sizes = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__off"))
    joined = null_safe_join(kept, offsets, by)
    return joined.withColumn(out, (F.col("__off") + F.col("__at")).cast("bigint")).drop("__part", "__off", "__at")


def running_totals(df: DataFrame, order: str, sums: Sequence[str], keys: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Cumulative sums over the distinct values of `order`, per key.

    Returns one row per (key, value) with `<s>`, its inclusive running total
    `cum_<s>` and the total of the key `tot_<s>`. The distinct values are dealt into
    range partitions, summed inside, and raised by the totals of the partitions before."""
    keys = list(keys)
    ordering = F.col(order).desc() if descending else F.col(order).asc()
    distinct = df.groupBy(*keys, order).agg(*[F.sum(s).alias(s) for s in sums])
    distinct = checkpoint(distinct.repartitionByRange(*keys, ordering)).withColumn("__part", F.spark_partition_id())
    by = keys + ["__part"]
    inside = Window.partitionBy(*by).orderBy(ordering).rowsBetween(Window.unboundedPreceding, 0)
    part = distinct.select("*", *[F.sum(s).over(inside).alias(f"__in_{s}") for s in sums])
    sizes = distinct.groupBy(*by).agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = sizes.select(
        *by,
        *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__off_{s}") for s in sums],
        *[F.sum(f"__t_{s}").over(whole).alias(f"tot_{s}") for s in sums],
    )
    joined = null_safe_join(part, offsets, by)
    return joined.select(
        *keys,
        order,
        *sums,
        *[(F.col(f"__off_{s}") + F.col(f"__in_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"tot_{s}") for s in sums],
    )


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Exact linear-interpolated quantiles, long form: keys, feature, q0, q1, ...

    A radix search over an order-preserving code: pass 1 counts rows by sign, exponent
    and ten bits of the mantissa and finds the buckets that hold the wanted ranks;
    pass 2 folds the rows of those buckets to distinct values, finds the wanted
    buckets of 21 further bits and ranks only the values inside. No window holds more
    than 2^22 rows, however close together the values lie. NaN counts as null;
    infinities are the ends of the axis.
    """
    keys = list(keys)
    long = df.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
                    for c in cols
                ]
            )
        ).alias("__kv"),
    ).select(*keys, "__kv.feature", "__kv.v")
    long = _with_code(long.filter(F.col("v").isNotNull() & ~F.isnan("v")), "v", "__c")
    long = long.withColumn("__b", F.shiftright("__c", 21))
    by = keys + ["feature"]
    hist = long.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    key_w = Window.partitionBy(*by)
    run_w = key_w.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.select(
        "*",
        F.sum("__n").over(run_w).alias("__hi"),
        F.sum("__n").over(key_w).alias("__tot"),
    ).withColumn("__lo", F.col("__hi") - F.col("__n"))

    # 0-based neighbouring ranks of each wanted position
    def pos(p: float) -> Column:
        return F.lit(float(p)) * (F.col("__tot") - 1)

    def holds(r: Column) -> Column:
        return (r >= F.col("__lo")) & (r < F.col("__hi"))

    wanted = reduce(
        lambda a, b: a | b,
        [holds(F.floor(pos(p))) | holds(F.ceil(pos(p))) for p in probs],
    )
    need = hist.filter(wanted).select(*by, "__b", "__lo", "__tot")
    picked = null_safe_join(long, need, by + ["__b"])
    values = picked.groupBy(*by, "__b", "__c", "v").agg(
        F.count(F.lit(1)).alias("__k"), F.first("__lo").alias("__base"), F.first("__tot").alias("__tot")
    )
    # the finer buckets that hold the wanted ranks
    fine = values.groupBy(*by, "__b", "__c").agg(
        F.sum("__k").alias("__n"), F.first("__base").alias("__base"), F.first("__tot").alias("__tot")
    )
    fine_w = Window.partitionBy(*by, "__b").orderBy("__c").rowsBetween(Window.unboundedPreceding, 0)
    fine = fine.withColumn("__hi", F.col("__base") + F.sum("__n").over(fine_w)).withColumn("__lo", F.col("__hi") - F.col("__n"))
    fine = fine.filter(wanted).select(*by, "__c", "__lo")
    values = null_safe_join(values.select(*by, "__c", "v", "__k", "__tot"), fine, by + ["__c"])
    in_w = Window.partitionBy(*by, "__c").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("__to", F.col("__lo") + F.sum("__k").over(in_w)).withColumn(
        "__from", F.col("__to") - F.col("__k")
    )

    def at(r: Column) -> Column:
        return F.max(F.when((r >= F.col("__from")) & (r < F.col("__to")), F.col("v")))

    aggs = []
    for i, p in enumerate(probs):
        aggs += [
            at(F.floor(pos(p))).alias(f"__l{i}"),
            at(F.ceil(pos(p))).alias(f"__h{i}"),
            F.max(pos(p) - F.floor(pos(p))).alias(f"__f{i}"),
        ]
    found = values.groupBy(*by).agg(*aggs)
    return found.select(
        *by,
        *[
            (F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * F.col(f"__f{i}")).alias(f"q{i}")
            for i in range(len(probs))
        ],
    )
