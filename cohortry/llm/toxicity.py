"""Toxicity by multiple-instance learning.

A document is a bag of sentences. The score of a sentence is logistic in its words and word
beginnings; the score of a document is their noisy-or, 1 - prod(1 - s), so one offending
sentence is enough. Only documents are labelled; training finds the sentences.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.session import checkpoint

_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_STARTS = (4, 5, 6)


def traits(word: str) -> set[str]:
    """A word (lower case) and its first 4, 5 and 6 letters."""
    return {word, *(f"{word[:k]}*" for k in _STARTS if len(word) >= k)}


def sentences(text: str | None) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text or "")]


def _bags(text: str | None, index: dict[str, int]) -> list[list[int]]:
    """Known traits of each sentence that has some."""
    out = []
    for s, e in sentences(text):
        got = {index[t] for w in set(_WORD.findall(text[s:e].lower())) for t in traits(w) if t in index}
        if got:
            out.append(sorted(got))
    return out


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    memo: dict[str, tuple] = field(default_factory=dict, repr=False, compare=False)

    def _of(self, word: str) -> tuple:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            found = self.memo[word] = tuple((t, self.weights[t]) for t in traits(word) if t in self.weights)
        return found

    def sentence_scores(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, score) of the sentences with a known trait; others count nothing."""
        out = []
        if not text or not any(map(self._of, set(_WORD.findall(text.lower())))):
            return out
        for s, e in sentences(text):
            got = dict(x for w in set(_WORD.findall(text[s:e].lower())) for x in self._of(w))
            if got:
                out.append((s, e, float(1 / (1 + np.exp(-np.clip(self.bias + sum(got.values()), -60, 60))))))
        return out


def fit(sample: DataFrame, max_traits: int = 20_000, evidence: float = 12.0, rounds: int = 60, l2: float = 0.02, rate: float = 0.5) -> ToxicityModel:
    """Fit on (key, text, y).

    Traits seen twice as often in toxic documents as in others are candidates if toxic
    documents times the log of that ratio reach `evidence`, which chance hardly gives
    among a few hundred thousand traits (at most `max_traits`, those with the most). Weights are trained
    by full-batch steps on the noisy-or likelihood; each step sums the gradient over
    partitions and moves two numbers a trait. The sample bounds all of it. Without both
    kinds of labels the model scores zero.
    """

    @F.pandas_udf("array<string>")
    def traits_of(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({t for w in set(_WORD.findall((x or "").lower())) for t in traits(w)}) for x in texts])

    rows = checkpoint(sample.select("text", "y").repartition(16))
    sizes = rows.agg(F.count("*").alias("n"), F.sum("y").alias("k")).first()
    n, k = sizes["n"], sizes["k"] or 0
    if not k or k == n:
        return ToxicityModel({}, -20.0)
    seen = rows.select("y", F.explode(traits_of("text")).alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    share, other = (F.col("k") + 0.5) / (k + 1), (F.col("n") - F.col("k") + 0.5) / (n - k + 1)
    seen = seen.where(share > 2 * other).withColumn("g", F.col("k") * F.log(share / other)).where(F.col("g") >= evidence)
    top = seen.orderBy(F.desc("g"), "t").limit(max_traits).select("t", "n", "k").collect()
    names = [r["t"] for r in top]
    index = {t: i for i, t in enumerate(names)}

    @F.pandas_udf("array<array<int>>")
    def bags_of(texts: pd.Series) -> pd.Series:
        return pd.Series([_bags(x, index) for x in texts])

    def packed(batches):
        """All bags of a partition as flat arrays."""
        flat, ends, docs, y = [], [], [], []
        for b in batches:
            for bag, label in zip(b["bags"], b["y"], strict=True):
                for sentence in bag:
                    flat.append(np.asarray(sentence, dtype=np.int32))
                    ends.append(len(sentence))
                    docs.append(len(y))
                y.append(label)
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        yield pd.DataFrame({c: [np.asarray(v, dtype=np.int32).tobytes()] for c, v in (("flat", flat), ("ends", ends), ("docs", docs), ("y", y))})

    data = checkpoint(rows.select("y", bags_of("text").alias("bags")).mapInPandas(packed, "flat binary, ends binary, docs binary, y binary"))
    weights = np.array([np.log(((r["k"] + 0.5) / (k + 1)) / ((r["n"] - r["k"] + 0.5) / (n - k + 1))) / 2 for r in top])
    bias, memory = -3.0, np.full(len(names) + 1, 1e-6)
    for _ in range(rounds):
        w, b = weights, bias

        def gradient(batches, w=w, b=b):
            total = np.zeros(len(w) + 1)
            for batch in batches:
                for row in batch.itertuples():
                    flat, ends, docs, y = (np.frombuffer(x, dtype=np.int32) for x in (row.flat, row.ends, row.docs, row.y))
                    if not len(ends):
                        continue
                    at = np.cumsum(ends) - ends
                    p = 1 / (1 + np.exp(-np.clip(b + np.add.reduceat(w[flat], at), -30, 30)))
                    keep = np.exp(np.bincount(docs, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)))
                    # d logL / d z_s = p_s * (y keep / (1 - keep) - (1 - y))
                    pull = np.where(y == 1, keep / np.maximum(1 - keep, 1e-6), -1.0)[docs] * p
                    total[:-1] += np.bincount(flat, np.repeat(pull, ends), len(w))
                    total[-1] += pull.sum()
            yield pd.DataFrame({"g": [total.tobytes()]})

        g = sum(np.frombuffer(r["g"]) for r in data.mapInPandas(gradient, "g binary").collect())
        g = g - l2 * np.append(weights, 0)
        memory += g * g
        step = rate * g / np.sqrt(memory)
        weights, bias = weights + step[:-1], bias + step[-1]
    kept = {t: float(x) for t, x in zip(names, weights, strict=True) if abs(x) > 1e-3}
    return ToxicityModel(kept, float(bias))


def judge(model: ToxicityModel, text: Column, cut: float = 0.5) -> Column:
    """struct(score, offending) of each whole text: the probability of a toxic document,
    and the sentences that score `cut` or more as (start, end, score), in characters. Null
    and empty texts score 0."""

    @F.pandas_udf("score double, offending array<struct<start:int,end:int,score:double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [model.sentence_scores(t) for t in texts]
        return pd.DataFrame({
            "score": [1 - float(np.prod([1 - p for _, _, p in x])) for x in found],
            "offending": [[{"start": s, "end": e, "score": p} for s, e, p in x if p >= cut] for x in found],
        })

    return run(text.cast("string"))
