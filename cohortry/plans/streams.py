"""Streaming queries (T): each drains the available rows and returns the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.plans.catalog import query, table
from cohortry.session import scratch_dir
from cohortry.streaming.scoring import keep_newest, latest_version, score_stream


def stream(spark, d, name):
    """One table of the folder as a stream."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query(
    "t01_stream_scoring",
    "SELECT event_id, round(p, 6) AS p1, (p > 0.5)::int AS prediction FROM (SELECT event_id, 1e0 / (1e0 + exp(-(value / 50e0 - 1e0))) AS p FROM events)",
)
def t01(spark, d):
    def score(df):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("value") / 50.0 - 1.0)))
        return df.select("event_id", p.alias("p1"), (p > 0.5).cast("int").alias("prediction"))

    out, ckpt = scratch_dir(spark), scratch_dir(spark)
    score_stream(stream(spark, d, "events"), score, out, ckpt, once=True).awaitTermination()
    return spark.read.parquet(out)


@query(
    "t02_newest_background",
    "SELECT event_type AS model, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 512",
)
def t02(spark, d):
    rows = stream(spark, d, "events").select(F.col("event_type").alias("model"), "event_id", "value", "ts")
    out, ckpt = scratch_dir(spark), scratch_dir(spark)
    keep_newest(rows, "model", ["ts", "event_id"], out, ckpt, 512, once=True).awaitTermination()
    return spark.read.parquet(f"{out}/v={latest_version(spark, out)}").select("model", "event_id", "value")
