"""Patient embeddings and similar patients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.knn import BLOCK_ROWS, euclidean, nearest, weighted_similarity
from cohortry.operators.preprocess import assemble, fit_imputer, fit_scaler


def embed(df: DataFrame, id_col: str, cols: Sequence[str], out: str = "vec") -> DataFrame:
    """id, vec: numeric columns, nulls by median, standard scale."""
    filled = fit_imputer(df, cols, "median").transform(df)
    return assemble(fit_scaler(filled, cols, "standard").transform(filled), cols, out).select(id_col, out)


def pca(emb: DataFrame, id_col: str, vec: str = "vec", k: int = 10) -> DataFrame:
    """Projection on the first min(k, d) principal components of scaled input."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    first = emb.select(F.size(vec).alias("d")).first()
    n = min(k, first["d"]) if first else k
    v = emb.withColumn("__v", array_to_vector(vec))
    return PCA(k=n, inputCol="__v", outputCol="__p").fit(v).transform(v).select(id_col, vector_to_array("__p").alias("components"))


def similar_patients(
    emb: DataFrame, id_col: str, k: int = 10, min_similarity: float = 0.3, queries: DataFrame | None = None,
    weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """patient, neighbour, similarity, rank for all (or the given) patients at once."""
    corpus = emb.select(F.col(id_col).alias("cid"), "vec")
    q = emb if queries is None else emb.join(queries.select(id_col), id_col, "left_semi")
    near = nearest(
        q.select(F.col(id_col).alias("qid"), "vec"), corpus, k, weighted_similarity(weights), floor=min_similarity, block_rows=block_rows
    )
    return near.select(
        F.col("qid").alias("patient"), F.col("cid").alias("neighbour"), F.col("score").alias("similarity"), "rank"
    )


def nearest_background(rows: DataFrame, background: DataFrame, id_col: str, bg_id: str, k: int = 2) -> DataFrame:
    """The k closest background rows by Euclidean distance."""
    near = nearest(
        rows.select(F.col(id_col).alias("qid"), "vec"), background.select(F.col(bg_id).alias("cid"), "vec"), k, euclidean(), exclude_self=False
    )
    return near.select(F.col("qid").alias(id_col), F.col("cid").alias(bg_id), (-F.col("score")).alias("distance"), "rank")
