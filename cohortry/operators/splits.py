"""Seeded splits, folds and samples with exact shares.

Rows are ordered by a seeded hash of their id. A boundary of that order is found
from a bucket histogram plus a sort of the one bucket it falls in, so labelling
all rows is a projection against a few thresholds: no sort and no shuffle of the
whole table, whatever the size of a stratum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.functions.seeded import seeded_hash
from cohortry.operators.ranks import hash_bucket, null_safe_join, small_side
from cohortry.session import checkpoint

Ends = Callable[[Column], Sequence[Column]]


def rank_thresholds(
    df: DataFrame, h: str, ids: Sequence[str], ends: Ends, keys: Sequence[str] = (), buckets: int = 4096
) -> DataFrame:
    """keys, t0, t1, ...: t_i is the (hash, ids) of the row at rank ends(n)[i] of its
    key, null where that rank is 0. The hash is narrowed in two steps, bucket and value,
    so that no window holds more than `buckets` or 2^32 / `buckets` rows. The wanted
    buckets, one per key and end, are kept first and the rows inside them once: two passes
    over the input, and only rows of those buckets move."""
    keys = list(keys)
    tagged = df.select(*keys, h, *ids, hash_bucket(F.col(h), buckets).alias("__b"))
    hist = tagged.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    key_w = Window.partitionBy(*keys)
    run = key_w.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.select(
        *keys, "__b", "__n", F.sum("__n").over(run).alias("__hi"), F.sum("__n").over(key_w).alias("__tot")
    ).withColumn("__lo", F.col("__hi") - F.col("__n"))
    bounds = list(ends(F.col("__tot")))
    need = hist.select(
        *keys, "__b", "__lo", "__hi", F.posexplode(F.array(*[b.cast("bigint") for b in bounds])).alias("__i", "__end")
    ).filter((F.col("__end") > F.col("__lo")) & (F.col("__end") <= F.col("__hi")))
    need = need.select(*keys, "__b", "__i", (F.col("__end") - F.col("__lo")).alias("__pos"))
    picked = checkpoint(null_safe_join(tagged, small_side(need), keys + ["__b"]))
    hashes = picked.groupBy(*keys, "__b", "__i", "__pos", h).agg(F.count(F.lit(1)).alias("__c"))
    upto = Window.partitionBy(*keys, "__b", "__i").orderBy(h).rowsBetween(Window.unboundedPreceding, 0)
    hashes = hashes.withColumn("__past", F.sum("__c").over(upto)).withColumn("__rest", F.col("__pos") - F.col("__past") + F.col("__c"))
    hashes = hashes.filter((F.col("__rest") > 0) & (F.col("__pos") <= F.col("__past"))).select(*keys, "__b", "__i", h, "__rest")
    at = null_safe_join(picked, hashes, [*keys, "__b", "__i", h])
    w = Window.partitionBy(*keys, "__b", "__i").orderBy(*ids)
    at = at.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") == F.col("__rest"))
    point = F.struct(h, *ids)
    return at.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == i, point)).alias(f"t{i}") for i in range(len(bounds))])


def assign_shares(
    df: DataFrame, ids: Sequence[str], seed: str, ends: Ends, labels: Sequence, out: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Label rows by hash rank: labels[i] up to ends(n)[i], the last label beyond."""
    keys = list(keys)
    tagged = df.withColumn("__h", seeded_hash(seed, *ids))
    th = rank_thresholds(tagged, "__h", ids, ends, keys)
    n = len(labels)
    point = F.struct("__h", *ids)
    if keys:
        joined = null_safe_join(tagged, small_side(th), keys, "left")
    else:  # one row of thresholds becomes literals
        row = th.first()
        joined = tagged
        for i in range(n - 1):
            t = row[f"t{i}"] if row is not None else None
            joined = joined.withColumn(f"t{i}", F.lit(None).cast("boolean") if t is None else literal_point(tagged, t, ["__h", *ids]))
        if row is None or all(row[f"t{i}"] is None for i in range(n - 1)):
            return tagged.withColumn(out, F.lit(labels[-1])).drop("__h")
        present = [i for i in range(n - 1) if row[f"t{i}"] is not None]
        label = F.lit(labels[-1])
        for i in reversed(present):
            label = F.when(point <= F.col(f"t{i}"), F.lit(labels[i])).otherwise(label)
        return joined.withColumn(out, label).drop("__h", *[f"t{i}" for i in range(n - 1)])
    label = reduce(
        lambda e, i: e.when(point <= F.col(f"t{i}"), F.lit(labels[i])),
        range(1, n - 1),
        F.when(point <= F.col("t0"), F.lit(labels[0])),
    ).otherwise(F.lit(labels[-1]))
    return joined.withColumn(out, label).drop("__h", *[f"t{i}" for i in range(n - 1)])


def literal_point(df: DataFrame, row, names: Sequence[str]) -> Column:
    """A (hash, ids) threshold as a literal struct with the types of its columns."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.struct(*[F.lit(row[n]).cast(types[n]).alias(n) for n in names])


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("bigint")


def split(
    df: DataFrame, ids: Sequence[str], target: str | None = None, test: float = 0.2, validation: float = 0.2,
    seed: int = 42, out: str = "split",
) -> DataFrame:
    """train / validation / test labels; the validation share is taken from what the
    test share leaves. With a target every class is split in the same shares."""
    if not 0 < test < 1 or not 0 <= validation < 1 or test + validation >= 1:
        raise ValueError("shares must be positive and leave rows for training")

    def ends(n: Column) -> list[Column]:
        n_test = half_up(n * F.lit(test))
        if validation == 0:
            return [n_test]
        return [n_test, n_test + half_up((n - n_test) * F.lit(validation / (1 - test)))]

    labels = ["test", "train"] if validation == 0 else ["test", "validation", "train"]
    return assign_shares(df, ids, str(seed), ends, labels, out, [target] if target else [])


def safe_split(df: DataFrame, ids: Sequence[str], target: str, test: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    """Stratified two-way split; plain when some class has fewer than two rows."""
    sizes = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    smallest = sizes.agg(F.min("n")).first()[0]
    return split(df, ids, target if smallest is not None and smallest >= 2 else None, test, 0, seed, out)


def kfold(df: DataFrame, ids: Sequence[str], k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Shuffled folds 0..k-1; the first n mod k folds hold one row more."""

    def ends(n: Column) -> list[Column]:
        return [F.floor(n / k) * i + F.least(n % k, F.lit(i)) for i in range(1, k)]

    return assign_shares(df, ids, str(seed), ends, list(range(k)), out)


def sample_rows(df: DataFrame, ids: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """A seeded sample of fixed size; a top-n merge, not a full sort."""
    h = seeded_hash(str(seed), *ids)
    return df.withColumn("__h", h).orderBy("__h", *ids).limit(n).drop("__h")


def inject_nulls(df: DataFrame, ids: Sequence[str], cols: Sequence[str], rate: float = 0.05, seed: int = 42) -> DataFrame:
    """Set exactly int(n * rate) values of each column to null."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), seeded_hash(f"{c}|{seed}", *ids).alias("h")) for c in cols])
    long = df.select(*ids, F.explode(cells).alias("c")).select(*ids, "c.feature", "c.h")
    th = rank_thresholds(long, "h", ids, lambda n: [F.floor(n * F.lit(rate))], ["feature"])
    cut = {r["feature"]: r["t0"] for r in th.collect()}  # one threshold per column
    fields = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for c in cols:
        if cut.get(c) is None:
            continue
        point = F.struct(seeded_hash(f"{c}|{seed}", *ids).alias("h"), *ids)
        limit = F.struct(F.lit(cut[c]["h"]).cast("bigint").alias("h"), *[F.lit(cut[c][i]).cast(fields[i]).alias(i) for i in ids])
        out[c] = F.when(point <= limit, F.lit(None)).otherwise(F.col(c))
    return df.withColumns(out)
