"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """csv (with header), parquet or json lines."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", "true").option("quoteAll", "false").option("escape", '"').csv(path)
    elif fmt in ("parquet", "json"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return path


def write_split(df: DataFrame, path: str, split_col: str = "split", fmt: str = "parquet") -> str:
    """Train and test parts in one write, one folder per part."""
    df.write.mode("overwrite").partitionBy(split_col).format(fmt).save(path)
    return path
