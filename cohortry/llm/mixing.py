"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to a power a and normalised. The power is found
by bisection, for a wanted entropy of the weights or a limit on how often a source may
be repeated. Budgets are realised as block permutations: a source is read in whole
shuffled blocks (each all of its documents once, in an order of its own) and its budget
ends inside the last block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import BROADCAST_KEYS, uniform
from cohortry.session import checkpoint

#: Documents of a source that share a cell of the permutation, about.
_CELL = 4096


def n_words(text: Column) -> Column:
    """Tokens of a text for the shares: runs of non-space characters; null: none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


@dataclass(frozen=True)
class Exponent:
    power: float
    entropy: float
    repetition: float


def _measure(totals: DataFrame, powers: list[float]) -> list[Exponent]:
    """Entropy of the weights and largest repetition (weight over share, relative to the
    smallest one) at each power, in one pass over the totals."""
    logp = F.ln(F.col("tokens") / F.col("all"))
    cols = []
    for k, a in enumerate(powers):
        e = F.exp(F.lit(a) * logp)
        cols += [F.sum(e).alias(f"z{k}"), F.sum(e * logp).alias(f"s{k}"), F.max((a - 1) * logp).alias(f"h{k}"), F.min((a - 1) * logp).alias(f"l{k}")]
    r = totals.where("tokens > 0").agg(*cols).first()
    return [Exponent(a, math.log(r[f"z{k}"]) - a * r[f"s{k}"] / r[f"z{k}"], math.exp(r[f"h{k}"] - r[f"l{k}"])) for k, a in enumerate(powers)]


def find_power(totals: DataFrame, entropy: float | None = None, repetition: float | None = None, points: int = 16, passes: int = 12) -> Exponent:
    """The power in [0, 1] that meets the target.

    entropy: share, from 0 to 1, of the way from the entropy at power 1 (the shares as
    they are) to that at power 0 (all sources alike). repetition: the source read most
    often may be read at most so many times as often as the one read least. Entropy and
    repetition both fall with the power, so the interval that holds the target is cut
    again and again; each pass over the totals tries `points` powers at once.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give either entropy or repetition")
    low, high = 0.0, 1.0
    flat, asis = _measure(totals, [0.0, 1.0])
    goal = None if entropy is None else asis.entropy + entropy * (flat.entropy - asis.entropy)
    over = (lambda m: m.entropy > goal) if goal is not None else (lambda m: m.repetition > repetition)
    if not over(flat):
        return flat
    for _ in range(passes):
        tried = _measure(totals, [low + (high - low) * k / points for k in range(1, points)])
        step = (high - low) / points
        k = sum(map(over, tried))
        low, high = low + step * k, low + step * (k + 1)
    return _measure(totals, [high])[0]


def plan(sized: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: int | None = None, cover: bool = False) -> tuple[DataFrame, Exponent | None]:
    """Per source (name, tokens, docs, weight, wanted): its budget in tokens.

    `sized` has a row per document: name, tokens. The budget of all sources together is
    `budget`, by default the tokens there are; with `cover` it is the smallest with which
    every source is read at least once. Sources without tokens get no budget.
    """
    totals = sized.groupBy("name").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    totals = checkpoint(totals)
    size = totals.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("m")).first()
    if not size["t"]:
        return totals.select("*", F.lit(0.0).alias("weight"), F.lit(0.0).alias("wanted")), None
    totals = totals.withColumn("all", F.lit(size["t"]))
    power = find_power(totals, entropy, repetition)
    e = F.when(F.col("tokens") > 0, F.exp(F.lit(power.power) * F.ln(F.col("tokens") / F.col("all")))).otherwise(0.0)
    totals = checkpoint(totals.withColumn("e", e))
    z = totals.agg(F.sum("e")).first()[0]
    totals = totals.withColumn("weight", F.col("e") / z).drop("all", "e")
    if cover:
        wanted = totals.where("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] * (1 + 1e-12)
    else:
        wanted = size["t"] if budget is None else budget
    return totals.withColumn("wanted", F.col("weight") * F.lit(float(wanted))), power


def mix(
    docs: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: int | None = None, cover: bool = False,
    seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(cuts, plan): how often each document is read.

    A source with T tokens and a budget of b is read in floor(b / T) whole blocks; of one
    more block, in an order drawn by `seed`, the documents whose tokens before them do not
    reach the rest of the budget. Null sources are one source; documents without tokens
    are read with the whole blocks only, and never in a source without tokens. `copies`
    turns the cuts into a column of the documents.
    """
    key = _position(F.col(id_col), F.col(text_col), seed)
    rows = docs.select(_name(F.col(source_col)).alias("name"), n_words(F.col(text_col)).alias("tokens"), key.alias("u"))
    rows = checkpoint(rows)
    budgets, _ = plan(rows.select("name", "tokens"), entropy, repetition, budget, cover)
    budgets = checkpoint(
        budgets.withColumn("blocks", F.when(F.col("tokens") > 0, F.floor(F.col("wanted") / F.col("tokens"))).otherwise(0))
        .withColumn("rest", F.col("wanted") - F.col("blocks") * F.col("tokens"))
        .withColumn("cells", F.ceil(F.col("docs") / _CELL))
    )
    side = _small(budgets.select("name", "cells", "rest"))
    placed = rows.join(side, "name").withColumn("cell", F.floor(F.col("u") * F.col("cells")))
    sums = placed.groupBy("name", "cell").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the cell in which the budget ends, and the tokens of the cells before it
    ends = checkpoint(sums.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest"))).select("name", "cell", "before"))
    inside = placed.join(_small(ends), ["name", "cell"]).groupBy("name", "u").agg(F.sum("tokens").alias("tokens"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    run = F.coalesce(F.sum("tokens").over(Window.partitionBy("name").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = inside.withColumn("run", F.col("before") + run).where(F.col("run") < F.col("rest")).groupBy("name").agg(F.max("u").alias("until"))
    cuts = budgets.join(last, "name", "left").select("name", "tokens", "docs", "weight", "wanted", "blocks", F.coalesce("until", F.lit(-1.0)).alias("until"))
    return checkpoint(cuts), budgets


def _name(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit("\x00none"))


def _position(doc_id: Column, text: Column, seed: int) -> Column:
    return uniform(doc_id, text, F.lit(seed))


def _small(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= BROADCAST_KEYS else side


def with_copies(docs: DataFrame, cuts: DataFrame, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", name: str = "copies") -> DataFrame:
    """The documents with the number of times each is read, as column `name` (it must not
    be a column already)."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    side = _small(cuts.select(F.struct("name", "blocks", "until").alias(f"{name} cut")))
    cut = side[f"{name} cut"]
    out = docs.join(side, _name(docs[source_col]) == cut["name"])
    more = (_position(docs[id_col], docs[text_col], seed) <= cut["until"]) & (n_words(docs[text_col]) > 0)
    return out.select(*(docs[c] for c in docs.columns), (cut["blocks"] + more.cast("int")).cast("bigint").alias(name))


def realise(docs: DataFrame, cuts: DataFrame, **columns) -> DataFrame:
    """The documents, each as often as it is read, with their own columns."""
    name = "copies"
    while name in docs.columns:
        name += "_"
    rows = with_copies(docs, cuts, name=name, **columns).where(F.col(name) > 0)
    return rows.select(*(rows[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(name).cast("int"))).alias(name)).drop(name)
