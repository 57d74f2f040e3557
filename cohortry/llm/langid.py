"""Language identification by cross-parsing entropy.

The labelled text of each language is kept as a suffix automaton. A text is parsed into
phrases, each the longest match from where the last one ended; a language in which the
text is common has long matches and needs few phrases. Phrases times log2 of the size of
the labelled text, over the length of the text, estimates the cross entropy in bits a
byte; the language with the smallest wins.

Texts are parsed as UTF-8 bytes of their lower case, with everything in ASCII that is not
a letter as one space. The parse starts anew every 256 bytes, which costs each language the
same few phrases and lets all stretches of a batch advance together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import held, uniform

_STRETCH = 256
_SPACE = 32
_TO_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else _SPACE for b in range(256))


def letters(text: str) -> np.ndarray:
    """Bytes of a text as they are parsed: a space, then words with one space between."""
    raw = np.frombuffer((" " + text.lower()).encode("utf-8", "surrogatepass").translate(_TO_LETTERS), dtype=np.uint8)
    space = raw == _SPACE
    keep = ~space
    keep[0] = True
    keep[1:] |= ~space[:-1]
    return raw[keep]


def automaton(data: bytes, codes: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton of some bytes, as (state, class) -> 2 * row + new.

    row is the next state times the width; new is 1 where the byte begins a phrase: at
    the start, and where a state has no transition and the byte is matched anew from the
    start. Class 0 stands still (beyond the end of a stretch); a class that the data lacks
    is a phrase by itself.
    """
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes[np.frombuffer(data, dtype=np.uint8)].tolist():
        cur, p = len(nexts), last
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    start = np.ones(width, dtype=np.int32)
    for c, to in nexts[0].items():
        start[c] = to * width << 1 | 1
    table = np.tile(start, (len(nexts), 1))
    table[:, 0] = np.arange(len(nexts)) * width << 1
    rows = np.repeat(np.arange(len(nexts)), [len(x) for x in nexts])
    cols = np.fromiter((c for x in nexts for c in x), dtype=np.int64)
    to = np.fromiter((t for x in nexts for t in x.values()), dtype=np.int64)
    inner = rows > 0
    table[rows[inner], cols[inner]] = to[inner] * width << 1
    return table.ravel()


@dataclass(frozen=True)
class LanguageModel:
    """Labelled text per language, a bounded sample; tasks build the automata from it."""

    texts: tuple[tuple[str, bytes], ...]


def _built(model: LanguageModel):
    return held(("automata", model), lambda: _build(model))


def _build(model: LanguageModel):
    seen = np.unique(np.frombuffer(b"".join(t for _, t in model.texts), dtype=np.uint8))
    codes = np.full(256, len(seen) + 1, dtype=np.int32)
    codes[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 2
    return codes, [(lang, automaton(t, codes, width), np.log2(max(2, len(t)))) for lang, t in model.texts]


def fit(
    docs: DataFrame, eligible: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    pieces: int = 160, piece_chars: int = 320,
) -> LanguageModel:
    """Learn from about `pieces` stretches of `piece_chars` characters of each language.

    A stretch begins at a place in the text given by the hash of the id, and the ids with
    the smallest hashes are taken, so the sample is bounded by the number of languages
    and does not depend on partitions. Rows without text or language are left out.
    """
    text, size = F.col(text_col), F.length(text_col)
    place = 1 + F.floor(uniform(F.col(id_col), F.lit("place")) * F.greatest(F.lit(1), size - piece_chars))
    rows = docs.where(eligible & F.col(lang_col).isNotNull() & (size > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.lit("pick")).alias("h"), text.substr(place.cast("int"), F.lit(piece_chars)).alias("piece")
    )
    w = Window.partitionBy("lang").orderBy("h", "piece")
    rows = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= pieces)
    found = rows.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "piece"))).alias("p")).orderBy("lang").collect()
    return LanguageModel(tuple((r["lang"], b"".join(letters(x["piece"]).tobytes() for x in r["p"])) for r in found))


def phrases(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bits a byte, phrases), each texts x languages, of texts that hold a letter."""
    codes, built = _built(model)
    parts = [codes[letters(t)] for t in texts]
    n = np.array([len(p) for p in parts])
    cuts = -(-n // _STRETCH)
    flat = np.zeros(int(cuts.sum()) * _STRETCH, dtype=np.int32)
    starts = (np.cumsum(cuts) - cuts) * _STRETCH
    for s, p in zip(starts, parts, strict=True):
        flat[s : s + len(p)] = p
    steps = np.ascontiguousarray(flat.reshape(-1, _STRETCH).T)
    owner = np.cumsum(cuts) - cuts
    bits, counts = np.empty((len(texts), len(built))), np.empty((len(texts), len(built)))
    for k, (_, table, log_size) in enumerate(built):
        row = np.zeros(steps.shape[1], dtype=np.int32)
        count = np.zeros(steps.shape[1], dtype=np.int32)
        for step in steps:
            value = table[row + step]
            count += value & 1
            row = value >> 1
        counts[:, k] = np.add.reduceat(count, owner) if len(owner) else 0
        bits[:, k] = counts[:, k] * log_size / n
    return bits, counts


def predict(model: LanguageModel, text: Column) -> Column:
    """struct(lang, score, bits, phrase_bytes) of each text.

    lang is `und` for a text that is null or has no letter (score 0). score is the margin
    1 - best / second best, in bits a byte (1 if only one language is known). Ties go to
    the language that sorts first. phrase_bytes is the mean phrase of the best language.
    """

    @F.pandas_udf("lang string, score double, bits double, phrase_bytes double")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"lang": "und", "score": 0.0, "bits": np.nan, "phrase_bytes": 0.0}, index=range(len(texts)))
        known = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if known and model.texts:
            bits, counts = phrases(model, [texts.iloc[k] for k in known])
            best = bits.argmin(axis=1)
            at = np.arange(len(known))
            low = bits[at, best]
            if bits.shape[1] > 1:
                score = 1 - low / np.partition(bits, 1, axis=1)[:, 1]
            else:
                score = np.ones(len(known))
            names = np.array([lang for lang, _ in model.texts], dtype=object)
            out.iloc[known, 0] = names[best]
            out.iloc[known, 1] = score
            out.iloc[known, 2] = low
            out.iloc[known, 3] = np.log2([max(2, len(t)) for _, t in model.texts])[best] / low
        return out

    return run(text.cast("string"))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row; other columns are not read. No shuffle."""
    p = docs.select(F.col(id_col).alias("doc_id"), predict(model, F.col(text_col)).alias("p"))
    return p.select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def accepted(model: LanguageModel, text: Column, min_phrase: float = 2.0, min_bytes: int = 64) -> Column:
    """Whether a text is in a known language: it has a letter, and where it is long
    enough to tell, its phrases in the best language are at least `min_phrase` bytes."""
    p = predict(model, text)
    return (p["lang"] != "und") & ((p["phrase_bytes"] >= min_phrase) | (F.octet_length(text) < min_bytes))
