"""Shared pieces of the text operators: folds, samples, pair blocks, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.session import checkpoint

#: Rows of one Arrow batch of texts: a batch is held in memory, and texts can be long.
TEXT_ROWS = 512
#: A side is broadcast by hand only up to so many rows; beyond, a shuffle join is used.
BROADCAST_KEYS = 100_000


_HELD: dict = {}


def held(key, build):
    """An object that a Python worker builds once and keeps for its next tasks. A worker
    keeps one at a time: workers outlive stages, and several large ones would add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def release() -> None:
    """Let go of what `held` keeps, for tasks that need none."""
    _HELD.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Batches sent to Python are cut to a size fit for long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > TEXT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(key, text, y) of about `max_rows` labelled rows at most.

    Rows are taken by a hash of the id, so the sample does not depend on partitions.
    Rows without a label are left out; several labels of one id count as the largest.
    The sampled ids are bounded by `max_rows` and therefore broadcast: texts are not
    shuffled.
    """
    known = labels.select(F.col(id_col).alias("key"), F.col(label).cast("int").alias("y")).where(
        F.col("key").isNotNull() & F.col("y").isNotNull()
    )
    known = known.where(keep).groupBy("key").agg(F.max("y").alias("y"))
    n = known.count()
    if n > max_rows:
        known = known.where(uniform(F.col("key"), F.lit("sample")) < max_rows / n)
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(known), "key")


def pair_blocks(rows: DataFrame, key: str, spread: Column, block: int) -> DataFrame:
    """Lists of the rows that share a key: (key, bi, bj, items).

    `items` holds (b, <other columns>) structs. A key with at most `block` rows is one
    list. A key with more is dealt into blocks by `spread`, and each pair of blocks is a
    list of its own, so no task ever holds a whole hot key and no pair of rows is lost.
    Lists of one row are left out.
    """
    cols = [c for c in rows.columns if c != key]
    counts = rows.groupBy(key).count()
    hot = checkpoint(counts.where(F.col("count") > block).select(key, F.ceil(F.col("count") / block).alias("nb")))
    n_hot = hot.count()
    cold = rows
    if n_hot:
        side = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        cold = rows.join(side, key, "left_anti")
    item = lambda b: F.struct(b.cast("int").alias("b"), *cols)
    lists = (
        cold.groupBy(key).agg(F.collect_list(item(F.lit(0))).alias("items")).where(F.size("items") > 1)
        .select(key, F.lit(0).alias("bi"), F.lit(0).alias("bj"), "items")
    )
    if n_hot:
        dealt = rows.join(side, key).withColumn("b", F.pmod(spread, F.col("nb")).cast("int"))
        dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), (F.col("nb") - 1).cast("int"))))
        dealt = dealt.select(key, F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), item(F.col("b")).alias("item"))
        lists = lists.unionByName(
            dealt.repartition(key, "bi", "bj").groupBy(key, "bi", "bj").agg(F.collect_list("item").alias("items"))
        )
    return lists


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, root) of every node of an undirected edge table (a, b) of longs.

    Alternating large-star and small-star steps: every round is two grouped minima with
    map-side combination, checkpointed in the shared folder. The root is the smallest
    node of the component. Self-loops count as nodes without links and are left out.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = checkpoint(e)
    seen = None
    while True:
        sign = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if sign["n"] == 0 or (seen is not None and sign == seen):
            break
        seen = sign
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = checkpoint(small.select("e.a", "e.b").where("a <> b").distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
