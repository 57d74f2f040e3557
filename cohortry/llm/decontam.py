"""Benchmark decontamination by spaced-seed hashing.

A mask picks some of the tokens in a window and ignores the others, so a window still
hashes alike after a token at an ignored place was replaced. Hashes of the test items under
a few fixed masks are joined with those of the training texts; around every hit the two
token sequences are laid over each other and compared, replaced tokens included.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import release

#: Masks of one window: "1" places are hashed, "0" places are ignored.
MASKS = ("111010010111", "110111001011", "101101110101")
_SPAN = len(MASKS[0])
#: Items with fewer tokens carry no signal and are not searched.
MIN_ITEM = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Items of one broadcast hold about so many tokens.
BLOCK_TOKENS = 500_000

_IS_WORD = np.zeros(256, dtype=bool)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _IS_WORD[_b] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first byte, end byte) of the tokens of some texts.

    Tokens are runs of letters and digits of the lower-cased text (in UTF-8, every byte
    beyond ASCII counts as a letter); the hash depends on the token only.
    """
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    word = _IS_WORD[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    first, end = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), first, end
    power = np.cumprod(np.full(len(raw), _BASE))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power)])
    inverse = np.cumprod(np.full(len(raw), _INVERSE))
    starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    owner = np.searchsorted(starts, first, side="right") - 1
    return _mix((total[end] - total[first]) * inverse[first]), owner, first - starts[owner], end - starts[owner]


def _places(mask: str) -> np.ndarray:
    return np.array([k for k, c in enumerate(mask) if c == "1"])


def windows(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the window under the mask at each position where it fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(len(mask)))
    for k in _places(mask):
        out *= _INVERSE
        out += h[k : k + n]
    return _mix(out)


@dataclass
class Block:
    """Some of the test items: their tokens and their hashes under every mask."""

    ids: np.ndarray
    item_tokens: list[np.ndarray]
    masks: tuple[str, ...]
    hashes: list[np.ndarray]
    items: list[np.ndarray]
    at: list[np.ndarray]
    sieve: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts: list[str]) -> Block:
        h, owner, _, _ = tokens(texts)
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        each = [h[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        # an item shorter than the masks is one window by itself
        short = sorted({len(t) for t in each if MIN_ITEM <= len(t) < _SPAN})
        masks = (*MASKS, *("1" * n for n in short))
        hashes, items, at = [], [], []
        for mask in masks:
            found = [(w, k) for k, t in enumerate(each) if (len(t) >= _SPAN if len(mask) == _SPAN else len(t) == len(mask)) for w in [windows(t, mask)]]
            w = np.concatenate([w for w, _ in found]) if found else np.zeros(0, np.uint64)
            order = np.argsort(w)
            hashes.append(w[order])
            items.append(np.concatenate([np.full(len(w), k) for w, k in found])[order] if found else np.zeros(0, np.int64))
            at.append(np.concatenate([np.arange(len(w)) for w, _ in found])[order] if found else np.zeros(0, np.int64))
        sieve = np.zeros(1 << 22, dtype=bool)
        for w in hashes:
            sieve[w >> np.uint64(42)] = True
        return cls(np.array(ids), each, masks, hashes, items, at, sieve)

    def hits(self, h: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Distinct (text, item, diagonal) of all windows that hash alike; the diagonal is
        the token of the texts on which the item's first token would lie."""
        found = []
        for mask, known, items, at in zip(self.masks, self.hashes, self.items, self.at, strict=True):
            w = windows(h, mask)
            if not len(w) or not len(known):
                continue
            p = np.flatnonzero(self.sieve[w >> np.uint64(42)])
            p = p[owner[p] == owner[p + len(mask) - 1]]
            lo, hi = np.searchsorted(known, w[p]), np.searchsorted(known, w[p], side="right")
            n = hi - lo
            p, lo = np.repeat(p, n), np.repeat(lo, n)
            k = lo + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.column_stack([owner[p], items[k], p - at[k]]))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def overlaps(self, texts: list[str | None], min_tokens: int, max_replaced: float) -> list[list[dict]]:
        """The longest overlap of each text with each item it shares one with."""
        h, owner, first, end = tokens(texts)
        out: list[dict] = [{} for _ in texts]
        for d, item, diagonal in self.hits(h, owner).tolist():
            t = self.item_tokens[item]
            lo, hi = np.searchsorted(owner, [d, d + 1])
            a, b = max(lo, diagonal), min(hi, diagonal + len(t))
            s, e, replaced = stretch(h[a:b] == t[a - diagonal : b - diagonal])
            n = e - s
            if n < min(min_tokens, len(t)) or replaced > max_replaced * n:
                continue
            best = out[d].get(item)
            if best is None or (n - 2 * replaced, -a) > (best["n_tokens"] - 2 * best["replaced"], -best["token"]):
                out[d][item] = {"item_id": int(self.ids[item]), "token": int(a), "start": int(first[a + s]), "end": int(end[a + e - 1]), "n_tokens": int(n), "replaced": int(replaced), "item_tokens": len(t)}
        return [[{k: v for k, v in m.items() if k != "token"} for m in x.values()] for x in out]


def stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, replaced) of the stretch with the most equal tokens, when a replaced
    token costs three equal ones; the first of several."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -3))])
    low = np.minimum.accumulate(total)
    e = int(np.argmax(total - low))
    s = int(np.flatnonzero(total[: e + 1] == low[e])[-1])
    return s, e, int((~equal[s:e]).sum())


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> list[Block]:
    """The test set, in blocks of a bounded number of tokens.

    Items with equal text are one item under the smallest id. Null and empty texts, null
    ids and items with fewer than five tokens are left out. A test set of any size is
    searched, one block at a time.
    """
    rows = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("id").isNotNull() & (F.length("text") > 0)).groupBy("text").agg(F.min("id").alias("id"))
    size = F.size(F.split("text", "[^0-9A-Za-z\u0080-\U0010ffff]+"))
    total = rows.agg(F.sum(size)).first()[0] or 0
    n = -(-total // block_tokens)
    out = []
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("id").collect()
        if part:
            out.append(Block.of([r["id"] for r in part], [r["text"] for r in part]))
    return out


def contamination(block: Block, text: Column, min_tokens: int = 13, max_replaced: float = 0.2) -> Column:
    """Overlaps of each text with the items of a block: array of structs."""

    @F.pandas_udf("array<struct<item_id:bigint,start:int,end:int,n_tokens:int,replaced:int,item_tokens:int>>")
    def run(texts: pd.Series) -> pd.Series:
        release()
        return pd.Series(block.overlaps(texts.tolist(), min_tokens, max_replaced))

    return run(text.cast("string"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per document and test item that overlap: doc_id, item_id, start, end (bytes
    of the lower-cased text in UTF-8), n_tokens, replaced, item_tokens.

    An overlap has at least `min_tokens` tokens (or the whole item, if that is shorter), of
    which at most the share `max_replaced` was replaced. Null and empty texts overlap with
    nothing; repeated rows give their rows each; other columns are not read. Texts are
    not shuffled: they are scanned once per block of the test set.
    """
    out = None
    for block in blocks(items):
        part = docs.select(F.col(id_col).alias("doc_id"), F.explode(contamination(block, F.col(text_col), **limits)).alias("m")).select("doc_id", "m.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.select(F.col(id_col).alias("doc_id"), *(F.lit(None).cast(t).alias(c) for c, t in (("item_id", "bigint"), ("start", "int"), ("end", "int"), ("n_tokens", "int"), ("replaced", "int"), ("item_tokens", "int")))).limit(0)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The documents, all columns, that overlap with no test item."""
    for block in blocks(items):
        docs = docs.where(F.size(contamination(block, F.col(text_col), **limits)) == 0)
    return docs
