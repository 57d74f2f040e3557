"""Fit/transform operators: imputation, scaling, encoding, and their column-wise
combination.

Fitting is one aggregate over the training rows that leaves one small row or
table of statistics; transforming is a projection of literals, or a join where a
code table may be large.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.numeric import numeric_columns, string_columns
from cohortry.operators.ranks import exact_quantiles, global_rank
from cohortry.session import checkpoint

MAX_DUMMY_CATEGORIES = 10_000


def long_form(df: DataFrame, cols: Sequence[str], kind: str, keep: Sequence[str] = ()) -> DataFrame:
    """keep..., feature, v: one row per cell."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("v")) for c in cols]
    return df.select(*keep, F.explode(F.array(*cells)).alias("__c")).select(*keep, "__c.feature", "__c.v")


def most_frequent(df: DataFrame, cols: Sequence[str], kind: str = "string") -> DataFrame:
    """feature, mode: the most frequent non-null value, the smallest on ties."""
    counts = (
        long_form(df, cols, kind).filter(F.col("v").isNotNull()).groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("feature").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("mode"))


# ---------------------------------------------------------------- imputation
@dataclass(frozen=True)
class Imputer:
    """One fill value per column, from the training rows."""

    fill: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.fill.items()})


def fit_imputer(df: DataFrame, cols: Sequence[str], strategy: str = "median", constant=None) -> Imputer:
    """median | mean | most_frequent | constant. A column without any value falls
    back to 0 (numeric) or "missing" (text)."""
    cols = list(cols)
    numeric = set(numeric_columns(df))
    default = {c: 0.0 if c in numeric else "missing" for c in cols}
    if not cols:
        return Imputer({})
    if strategy == "constant":
        return Imputer({c: constant if constant is not None else default[c] for c in cols})
    if strategy == "median":
        got = {r["feature"]: r["q0"] for r in exact_quantiles(df, cols, [0.5]).collect()}
    elif strategy == "mean":
        got = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    elif strategy == "most_frequent":
        got = {}
        for kind, some in (("double", [c for c in cols if c in numeric]), ("string", [c for c in cols if c not in numeric])):
            if some:
                got |= {r["feature"]: r["mode"] for r in most_frequent(df, some, kind).collect()}
    else:
        raise ValueError(f"unknown imputation strategy {strategy!r}")
    return Imputer({c: got.get(c) if got.get(c) is not None else default[c] for c in cols})


# ------------------------------------------------------------------- scaling
@dataclass(frozen=True)
class Scaler:
    """(x - centre) / spread per column."""

    centre: dict
    spread: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(self.centre[c])) / F.lit(self.spread[c]) for c in self.centre})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(self.spread[c]) + F.lit(self.centre[c]) for c in self.centre})


def fit_scaler(df: DataFrame, cols: Sequence[str], method: str = "standard") -> Scaler:
    """standard: mean and population deviation; minmax: minimum and range; robust:
    median and interquartile range. A zero spread counts as 1."""
    cols = list(cols)
    if not cols:
        return Scaler({}, {})
    if method == "robust":
        rows = {r["feature"]: r for r in exact_quantiles(df, cols, [0.25, 0.5, 0.75]).collect()}
        centre = {c: rows[c]["q1"] if c in rows else 0.0 for c in cols}
        spread = {c: rows[c]["q2"] - rows[c]["q0"] if c in rows else 1.0 for c in cols}
    else:
        mid, wide = {
            "standard": (F.avg, F.stddev_pop),
            "minmax": (F.min, lambda c: F.max(c) - F.min(c)),
        }.get(method, (None, None))
        if mid is None:
            raise ValueError(f"unknown scaling method {method!r}")
        row = df.agg(
            *[mid(c).cast("double").alias(f"m_{c}") for c in cols], *[wide(c).cast("double").alias(f"s_{c}") for c in cols]
        ).first()
        centre = {c: row[f"m_{c}"] or 0.0 for c in cols}
        spread = {c: row[f"s_{c}"] for c in cols}
    tiny = {c: 10 * 2.3e-16 * max(abs(centre[c]), 1.0) for c in cols}
    return Scaler(centre, {c: s if s is not None and abs(s) > tiny[c] else 1.0 for c, s in spread.items()})


# ------------------------------------------------------------------ encoding
def categories(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct values per column. Refuses unbounded category sets: those
    belong to `ordinal_codes`, which stays distributed."""
    found = long_form(df, cols, "string").filter(F.col("v").isNotNull()).distinct()
    rows = found.limit(MAX_DUMMY_CATEGORIES + 1).collect()
    if len(rows) > MAX_DUMMY_CATEGORIES:
        raise ValueError(f"more than {MAX_DUMMY_CATEGORIES} categories; use ordinal_codes")
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[r["feature"]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


@dataclass(frozen=True)
class OneHot:
    """Dummy columns `col_value`, the first category dropped; unknown is all zero."""

    levels: dict

    @property
    def names(self) -> list[str]:
        return [f"{c}_{v}" for c, vs in self.levels.items() for v in vs[1:]]

    def transform(self, df: DataFrame) -> DataFrame:
        cols = {
            f"{c}_{v}": F.coalesce((F.col(c).cast("string") == v), F.lit(False)).cast("double")
            for c, vs in self.levels.items()
            for v in vs[1:]
        }
        return df.withColumns(cols).drop(*self.levels) if cols else df.drop(*self.levels)

    def inverse(self, df: DataFrame) -> DataFrame:
        """First category unless a dummy is set (an unknown one cannot be told apart)."""
        out = df
        for c, vs in self.levels.items():
            expr = reduce(lambda e, v: e.when(F.col(f"`{c}_{v}`") == 1, F.lit(v)), vs[1:], F.when(F.lit(False), F.lit(None)))
            out = out.withColumn(c, expr.otherwise(F.lit(vs[0] if vs else None)))
        return out.drop(*self.names)


def fit_onehot(df: DataFrame, cols: Sequence[str]) -> OneHot:
    return OneHot(categories(df, cols)) if cols else OneHot({})


def ordinal_codes(df: DataFrame, col: str) -> DataFrame:
    """value, code: alphabetical codes from 0, as a distributed table."""
    distinct = df.select(F.col(col).cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct()
    ranked = global_rank(distinct, ["value"], out="code")
    return ranked.select("value", (F.col("code") - 1).cast("bigint").alias("code"))


def apply_ordinal(df: DataFrame, col: str, codes: DataFrame, out: str | None = None) -> DataFrame:
    """Replace a column by its code; unknown and null become -1."""
    out = out or col
    side = codes.select(F.col("value").alias("__v"), F.col("code").alias("__code"))
    joined = df.join(side, F.col(col).cast("string") == F.col("__v"), "left").drop("__v")
    return joined.withColumn(out, F.coalesce("__code", F.lit(-1).cast("bigint"))).drop("__code")


def combined_dummies(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Dummies with the categories of both parts."""
    enc = fit_onehot(train.select(*cols).unionByName(test.select(*cols)), cols)
    return enc.transform(train), enc.transform(test)


# ----------------------------------------------------------- column-wise whole
@dataclass
class Preprocessor:
    """impute -> scale for numeric columns, impute -> encode for text columns.

    NaN counts as null. With `numeric_imputation="knn"` the training rows are kept as donors,
    a table; fills are the means of the nearest donors."""

    numeric_imputation: str = "median"
    categorical_imputation: str = "most_frequent"
    scaling: str | None = "standard"
    encoding: str = "onehot"
    numeric: list = field(default_factory=list)
    categorical: list = field(default_factory=list)
    passthrough: list = field(default_factory=list)
    parts: dict = field(default_factory=dict)
    knn_neighbours: int = 5
    donors: DataFrame | None = field(default=None, repr=False, compare=False)

    def _clean(self, df: DataFrame) -> DataFrame:
        floats = [c for c in self.numeric if dict(df.dtypes).get(c) in ("double", "float")]
        return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df

    def _fill_numbers(self, df: DataFrame) -> DataFrame:
        if self.numeric_imputation != "knn" or not self.numeric:
            return Imputer(self.parts["numeric"]).transform(df)
        from cohortry.operators.knn import knn_impute

        rows = checkpoint(df.withColumn("__row", F.monotonically_increasing_id()))
        return knn_impute(rows, "__row", self.numeric, self.knn_neighbours, self.donors).drop("__row")

    def fit(self, df: DataFrame, exclude: Sequence[str] = ()) -> "Preprocessor":
        self.numeric = numeric_columns(df, exclude)
        self.categorical = string_columns(df, exclude)
        self.passthrough = [c for c in df.columns if c not in {*self.numeric, *self.categorical}]
        if not self.numeric and not self.categorical:
            raise ValueError("no numeric and no categorical column to preprocess")
        df = self._clean(df)
        self.parts = {}
        if self.numeric_imputation == "knn":
            self.donors = checkpoint(df.select(*self.numeric, F.monotonically_increasing_id().alias("__row")))
        else:
            self.parts["numeric"] = fit_imputer(df, self.numeric, self.numeric_imputation).fill
        cat = fit_imputer(df, self.categorical, self.categorical_imputation)
        self.parts["categorical"] = cat.fill
        imputed = cat.transform(self._fill_numbers(df))
        if self.scaling:
            s = fit_scaler(imputed, self.numeric, self.scaling)
            self.parts |= {"centre": s.centre, "spread": s.spread}
        self.parts["levels"] = categories(imputed, self.categorical) if self.categorical else {}
        return self

    def check_columns(self, df: DataFrame) -> list[str]:
        """Warnings about columns that differ from the fitted ones."""
        want, have = set(self.numeric + self.categorical), set(df.columns)
        out = [f"missing column {c}" for c in sorted(want - have)]
        return out + [f"unexpected column {c}" for c in sorted(have - want - set(self.passthrough))]

    def transform(self, df: DataFrame) -> DataFrame:
        for message in self.check_columns(df):
            import warnings

            warnings.warn(message, stacklevel=2)
        for c in self.numeric:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("double"))
        for c in self.categorical:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("string"))
        df = Imputer(self.parts["categorical"]).transform(self._fill_numbers(self._clean(df)))
        if self.scaling:
            df = Scaler(self.parts["centre"], self.parts["spread"]).transform(df)
        if self.encoding == "onehot":
            df = OneHot(self.parts["levels"]).transform(df)
        else:
            for c, vs in self.parts["levels"].items():
                if vs:
                    pairs = F.create_map(*[F.lit(x) for i, v in enumerate(vs) for x in (v, float(i))])
                    df = df.withColumn(c, F.coalesce(F.try_element_at(pairs, F.col(c)), F.lit(-1.0)))
        return df.select(*[F.col(f"`{c}`") for c in self.output_names], *[c for c in self.passthrough if c in df.columns])

    def fit_transform(self, df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
        return self.fit(df, exclude).transform(df)

    @property
    def output_names(self) -> list[str]:
        if self.encoding == "onehot":
            return self.numeric + OneHot(self.parts["levels"]).names
        return self.numeric + self.categorical

    def inverse(self, df: DataFrame) -> DataFrame:
        if self.scaling:
            df = Scaler(self.parts["centre"], self.parts["spread"]).inverse(df)
        if self.encoding == "onehot":
            return OneHot(self.parts["levels"]).inverse(df)
        for c, vs in self.parts["levels"].items():
            arr = F.array(*[F.lit(v) for v in vs]) if vs else F.array().cast("array<string>")
            df = df.withColumn(c, F.when(F.col(c) >= 0, F.get(arr, F.col(c).cast("int"))))
        return df

    def info(self, spark: SparkSession) -> DataFrame:
        """One row per input column: what happens to it."""
        rows = [(c, "numeric", self.numeric_imputation, self.scaling or "none", 1) for c in self.numeric]
        for c in self.categorical:
            n = len(self.parts["levels"].get(c, []))
            rows.append((c, "categorical", self.categorical_imputation, self.encoding, max(n - 1, 0) if self.encoding == "onehot" else 1))
        rows += [(c, "passthrough", "none", "none", 1) for c in self.passthrough]
        return spark.createDataFrame(rows, "column string, kind string, imputation string, step string, n_outputs int")

    # fitted state as a one-row-per-entry table
    def save(self, spark: SparkSession, path: str) -> None:
        spec = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "donors"}
        spark.createDataFrame([(json.dumps(spec),)], "spec string").coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")
        if self.donors is not None:
            self.donors.write.mode("overwrite").parquet(f"{path}/donors")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Preprocessor":
        pre = Preprocessor(**json.loads(spark.read.parquet(f"{path}/spec").first()["spec"]))
        if pre.numeric_imputation == "knn":
            pre.donors = spark.read.parquet(f"{path}/donors")
        return pre


def assemble(df: DataFrame, cols: Sequence[str], out: str = "vec") -> DataFrame:
    """Columns to one array<double>."""
    return df.withColumn(out, F.array(*[F.col(f"`{c}`").cast("double") for c in cols]))
