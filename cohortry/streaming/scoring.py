"""Scoring and background upkeep over streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from cohortry.sources.readers import path_exists


def score_stream(
    rows: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, fmt: str = "parquet", once: bool = False
) -> StreamingQuery:
    """Stateless scoring of arriving rows, appended to a file sink (exactly once)."""
    writer = score(rows).writeStream.outputMode("append").format(fmt).option("path", sink).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def latest_version(spark: SparkSession, folder: str, below: int | None = None) -> int | None:
    """Largest complete version v=<n> in a folder."""
    if not path_exists(spark, folder):
        return None
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")):
            n = int(name[2:])
            if below is None or n < below:
                found.append(n)
    return max(found) if found else None


def newest(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def keep_newest(
    rows: DataFrame, key: str, order: Sequence[str], folder: str, checkpoint: str, n: int = 512, once: bool = False
) -> StreamingQuery:
    """The newest n rows per key as versioned snapshots folder/v=<batch>.

    A batch merges with the version before it and writes a new one, so a replayed
    batch gives the same result; the state is n rows per key."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = latest_version(spark, folder, below=batch_id)
        merged = batch if last is None else batch.unionByName(spark.read.parquet(f"{folder}/v={last}"))
        newest(merged, key, order, n).write.mode("overwrite").parquet(f"{folder}/v={batch_id}")

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
