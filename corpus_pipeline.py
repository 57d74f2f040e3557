"""From documents to token files: language, near-duplicates, benchmark, mixing, output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import decontam, langid, mixing, simhash, tokenstore
from cohortry.llm.common import fold, table
from cohortry.session import checkpoint, scratch_dir

#: A source may be read at most so many times as often as the one read least.
REPETITION = 2.0
TOKENIZER = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters, and longer ones that no
    language matches, go. Null texts go."""
    model = langid.fit(docs, fold(F.col("doc_id"), 4) != 2)
    return docs.where(langid.accepted(model, F.col("text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest doc_id (null
    last), then the first read. Rows are removed as rows, so a repeated id with another
    text is a document of its own and stays when its group has no smaller row."""
    rows = checkpoint(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = simhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), n=3, max_bits=3)
    ids = rows.select(F.col("_row").alias("r"), F.col("doc_id").alias("i"))
    pick = F.min(F.struct(F.col("i").isNull().alias("z"), F.col("i").alias("i"), F.col("r").alias("r")))
    keep = found.join(ids, found.doc_id == ids.r).groupBy("root").agg(pick.alias("k")).select(F.col("k.r").alias("_row"))
    return rows.join(keep, "_row", "left_semi").drop("_row")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to `REPETITION` times. A
    repeated document is a repeated row."""
    cuts, _ = mixing.mix(docs, repetition=REPETITION, cover=True)
    return mixing.realise(docs, cuts)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Written and read again: doc_id, start, n_tokens, ids_crc32 of each row."""
    import public_tokenizers

    return tokenstore.round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
    ("token-ID output", token_files),
]

#: SQL has no XXH64, no suffix automaton and no tokenizer; tests/llm compares run() with a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        folder = scratch_dir(spark, f"stage{k}-")
        out.write.parquet(folder)
        docs = spark.read.parquet(folder)
