"""Token counts with a whole-token shortcut.

Before counting, every string of the vocabulary is put through the merges once; those that
come out as one token are kept as whole. A pre-token of a text found among them counts one
without any merging; only the others are merged.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import held

_MEMO = 800_000


class Counter:
    """Token counts of texts under a word-level tokenizer that drops white space."""

    def __init__(self, path: str, memo: int = _MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = self.tokenizer.model.end_of_word_suffix or ""
        self.whole = self.proved()
        self.memo: dict[str, int] = {}
        self.limit = memo

    def proved(self) -> frozenset[str]:
        """Pre-tokens (in the byte alphabet) that encode alone as exactly one token."""
        model, end = self.tokenizer.model, self.end
        vocabulary = (t.removesuffix(end) for t in self.tokenizer.get_vocab(with_added_tokens=False) if t.endswith(end))
        return frozenset(t for t in vocabulary if t and len(model.tokenize(t)) == 1)

    def _merged(self, token: str) -> int:
        return 1 if token in self.whole else len(self.tokenizer.model.tokenize(token))

    def _piece(self, piece: str) -> int:
        """Tokens of a stretch between spaces and line breaks."""
        if piece.isascii() and piece.isalpha():
            return self._merged(piece.lower())
        seen = self.tokenizer.normalizer.normalize_str(piece)
        return sum(self._merged(t) for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(seen))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; the strings of special tokens count one each."""
        if not text:
            return 0
        if any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        pieces = text.replace("\n", " ").split(" ")
        counts = list(map(self.memo.get, pieces))
        if None in counts:
            if len(self.memo) > self.limit:
                self.memo.clear()
            for k, (p, c) in enumerate(zip(pieces, counts, strict=True)):
                if c is None:
                    counts[k] = self.memo[p] = self._marked(p)
        return sum(counts)

    def _marked(self, piece: str) -> int:
        """A comma or full stop right after an ASCII letter is a pre-token by itself."""
        stem = piece[:-1]
        if piece[-1:] in (",", ".") and stem.isascii() and stem.isalpha():
            c = self.memo.get(stem)
            if c is None:
                c = self.memo[stem] = self._piece(stem)
            return c + self._merged(piece[-1])
        return self._piece(piece)


def counter(path: str) -> Counter:
    return held(("counter", path), lambda: Counter(path))


def n_tokens(text: Column, tokenizer: str) -> Column:
    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        count = counter(tokenizer).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    return run(text.cast("string"))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row. Null and empty texts have no
    tokens; repeated rows are counted each; other columns are not read. No shuffle."""
    text = F.col(text_col).cast("string")
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), n_tokens(text, tokenizer).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
