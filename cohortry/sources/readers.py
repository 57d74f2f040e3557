"""Table readers."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".tsv": "tsv"}


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm_path)


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "auto",
    schema: T.StructType | str | None = None,
    options: Mapping[str, str] | None = None,
    limit: int | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Read csv, tsv, parquet or json by explicit format or by suffix.

    `limit` is off by default; with `order_by` it is deterministic (top-n merge)."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    if fmt == "auto":
        suffix = os.path.splitext(path.rstrip("/"))[1].lower()
        fmt = FORMATS.get(suffix, suffix.lstrip("."))
    if fmt not in FORMATS.values():
        raise ValueError(f"unsupported format {fmt!r}")
    reader = spark.read.options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    if fmt in ("csv", "tsv"):
        reader = reader.option("header", "true").option("sep", "\t" if fmt == "tsv" else ",")
        if schema is None:
            reader = reader.option("inferSchema", "true")
        df = reader.csv(path)
    else:
        df = reader.format(fmt).load(path)
    if limit is not None:
        df = (df.orderBy(*order_by) if order_by else df).limit(limit)
    return df


def read_headerless(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, null_markers: Sequence[str] = ("?",), sep: str = ","
) -> DataFrame:
    """Delimited text without a header. The first marker is handled by the reader,
    further markers by comparing the raw text before the cast."""
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in target.fields])
    text = spark.read.schema(raw).option("sep", sep).option("ignoreLeadingWhiteSpace", "true").option(
        "ignoreTrailingWhiteSpace", "true"
    ).csv(path if isinstance(path, str) else list(path))
    markers = list(null_markers)

    def parse(f: T.StructField) -> Column:
        c = F.when(~F.col(f.name).isin(markers), F.col(f.name))
        return (c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)).alias(f.name)

    return text.select(*[parse(f) for f in target.fields])


def read_splits(spark: SparkSession, paths: Mapping[str, str], schema, sep: str = "\t") -> DataFrame:
    """Delimited splits with a header, tagged by split name."""
    out = None
    for split, path in paths.items():
        part = spark.read.schema(schema).option("sep", sep).option("header", "true").option("quote", '"').option(
            "escape", '"'
        ).option("multiLine", "true").csv(path)
        part = part.withColumn("dataset_split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def union_sites(sites: Mapping[str, DataFrame | None], tag: str = "site") -> DataFrame:
    """Union of site tables tagged with the site; missing and empty sites drop out."""
    out = None
    for site, df in sites.items():
        if df is None or df.isEmpty():
            continue
        part = df.withColumn(tag, F.lit(site))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no site has any row")
    return out


def read_unnamed_parts(spark: SparkSession, paths: Sequence[str], null_markers: Sequence[str] = ("?",)) -> DataFrame:
    """Headerless parts read as one: generated names, the last column is the label."""
    raw = spark.read.csv(list(paths))
    n = len(raw.columns)
    names = [f"feature_{i}" for i in range(n - 1)] + ["target_raw"]
    df = raw.toDF(*names)
    return df.select(*[F.when(~F.col(c).isin(list(null_markers)), F.col(c)).alias(c) for c in names])


def scan_labelled_files(
    spark: SparkSession, root: str, extensions: Sequence[str] = ("jpg", "jpeg", "png", "bmp")
) -> DataFrame:
    """split/label/**/file trees: path, split and label only, the bytes stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    rel = F.regexp_extract("path", r".*?/" + os.path.basename(root.rstrip("/")) + r"/(.*)$", 1)
    df = files.withColumn("__rel", rel)
    parts = F.split("__rel", "/")
    df = df.select(
        F.col("__rel").alias("image_path"),
        F.lower(parts[0]).alias("split"),
        F.trim(parts[1]).alias("lesion_label"),
        F.lower(F.regexp_extract("__rel", r"\.([^./]+)$", 1)).alias("extension"),
        F.size(parts).alias("__depth"),
    )
    keep = F.col("extension").isin(list(extensions)) & (F.col("__depth") >= 3)
    visible = ~F.col("split").startswith(".") & ~F.col("lesion_label").startswith(".")
    return df.filter(keep & visible).drop("__depth").withColumn(
        "lesion_label_clean", F.regexp_replace(F.lower("lesion_label"), " ", "_")
    )


def read_sectioned_lookup(spark: SparkSession, path: str) -> DataFrame:
    """column, code, description from a text of sections divided by a lone comma.

    The first line of a section is its header; blank descriptions become Unknown,
    codes that are no number drop out."""
    text = spark.read.text(path, wholetext=True)
    body = F.regexp_replace(F.col("value"), "\r", "")
    sections = text.select(F.explode(F.split(body, r"(?m)^\s*,\s*$")).alias("section"))
    lines = F.filter(F.transform(F.split("section", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    s = sections.select(lines.alias("l")).filter(F.size("l") > 0)
    header = F.split(F.col("l")[0], ",")
    s = s.filter(F.size(header) == 2).select(
        F.trim(header[0]).alias("column"), F.explode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))).alias("row")
    )

    def unquote(c: Column) -> Column:
        return F.regexp_replace(F.trim(c), '^"+|"+$', "")

    code = unquote(F.regexp_extract("row", r"^([^,]*),", 1)).try_cast("double").try_cast("bigint")
    desc = unquote(F.regexp_extract("row", r"^[^,]*,(.*)$", 1))
    return s.filter(F.col("row").contains(",")).select(
        "column",
        code.alias("code"),
        F.when((desc == "") | (F.upper(desc) == "NULL"), F.lit("Unknown")).otherwise(desc).alias("description"),
    ).filter(F.col("code").isNotNull())
