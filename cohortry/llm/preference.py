"""Preference formatting: one prompt and two masked completions from a pair of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written. Only text of the `learned` role is trained on, with its end mark.
HEAD, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def conversations(turns: DataFrame, id_col: str, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(pair_id, turns): the turns of each conversation in order, as an array of structs."""
    turn = F.struct(F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("pair_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def render(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), F.coalesce(turn["role"], F.lit("")), F.lit(MIDDLE), F.coalesce(turn["text"], F.lit("")), F.lit(END))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix: turns with equal role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]) & x.isNotNull() & y.isNotNull(), F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def _rest(turns: Column, skip: Column) -> Column:
    return F.when(F.size(turns) > skip, F.slice(turns, skip + 1, F.size(turns))).otherwise(F.slice(turns, 1, 0))


def _completion(turns: Column, learned: str) -> Column:
    """(text, spans): the rendered turns, and the character ranges that are trained on."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        head = F.lit(len(HEAD) + len(MIDDLE)) + F.length(F.coalesce(turn["role"], F.lit("")))
        body = F.length(F.coalesce(turn["text"], F.lit(""))) + len(END)
        first = (state["at"] + head).cast("int")
        last = (first + body).cast("int")
        span = F.struct(first.alias("start"), last.alias("end"))
        return F.struct(last.alias("at"), F.when(turn["role"] == learned, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(turns, start, add, lambda s: s["spans"])
    return F.struct(F.array_join(F.transform(turns, render), "").alias("text"), spans.alias("spans"))


def format_pairs(chosen: DataFrame, rejected: DataFrame, learned: str = "assistant") -> DataFrame:
    """One row a pair: pair_id, prompt_turns, prompt, chosen, rejected.

    Both inputs have (pair_id, turn, role, text). The longest common prefix of turns is
    rendered once as the prompt; the turns after it are the completions, structs of text
    and spans, where spans are the characters of `learned` turns. Turns are ordered by
    number, then role and text (repeated numbers keep all their turns, nulls first), null
    texts are empty, a null id is left out. A pair whose conversations are equal has two
    empty completions; a pair with one side only has an empty completion on the other and
    no common turn. One conversation is one row; only pairs meet in a join.
    """
    a, b = (conversations(t, "pair_id").withColumnRenamed("turns", n) for t, n in ((chosen, "c"), (rejected, "r")))
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    both = a.join(b, "pair_id", "full_outer").select("pair_id", F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    both = both.withColumn("k", common_turns(F.col("c"), F.col("r")))
    return both.select(
        "pair_id", F.col("k").alias("prompt_turns"), F.array_join(F.transform(F.slice("c", F.lit(1), F.col("k")), render), "").alias("prompt"),
        _completion(_rest(F.col("c"), F.col("k")), learned).alias("chosen"), _completion(_rest(F.col("r"), F.col("k")), learned).alias("rejected"),
    )


def answer_pairs(turns: DataFrame, id_col: str = "conv_id", learned: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """Turns of chosen and rejected conversations made from a table of conversations.

    Chosen is a conversation as it is. Rejected is the same conversation in which the last
    answer, and all that follows, is replaced by the last answer of the conversation with
    the next id (by nothing, if there is none). Conversations without an answer make no pair.
    """
    t = turns.select(F.col(id_col).cast("bigint").alias("pair_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    last = t.where(F.col("role") == learned).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("m")).select("pair_id", F.col("m.turn").alias("cut"), F.col("m.text").alias("answer"))
    chosen = t.join(last.select("pair_id"), "pair_id")
    kept = t.join(last.select("pair_id", "cut"), "pair_id").where(F.col("turn") < F.col("cut")).drop("cut")
    other = last.select((F.col("pair_id") - 1).alias("pair_id"), "answer").join(last.select("pair_id", "cut"), "pair_id")
    swapped = other.select("pair_id", F.col("cut").alias("turn"), F.lit(learned).alias("role"), F.col("answer").alias("text"))
    return chosen, kept.unionByName(swapped)
