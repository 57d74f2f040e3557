"""Near-duplicates by 64-bit SimHash, found through a byte-position inverted index."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import components, pair_blocks, release
from cohortry.session import checkpoint

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LIST = 2048
_MEMBER = "array<struct<a:bigint,b:bigint>>"


def shingle_hashes(text: str | None, n: int) -> list[int]:
    """XXH64 (seed 42) of the n-word shingles of a text, repeats included.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A text with
    fewer words is one shingle; a text without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(joined, 42)]
    digest = xxhash.xxh64_intdigest
    starts = [0, *(e + 1 for e in ends[: len(words) - n])]
    return [digest(joined[s:e], 42) for s, e in zip(starts, ends[n - 1 :], strict=True)]


def simhash(text: str | None, n: int = 3) -> int:
    """Unsigned fingerprint: a bit is set if it is set in over half of the hashes."""
    h = np.array(shingle_hashes(text, n), dtype=">u8")
    if not len(h):
        return 0
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprint(text: Column, n: int = 3) -> Column:
    """The fingerprint as a signed long (null and empty texts: 0)."""

    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        release()
        return pd.Series(np.array([simhash(t, n) for t in texts], dtype=np.uint64).view(np.int64))

    return run(text.cast("string"))


def _prefix(max_bits: int) -> tuple[int, list[tuple[int, ...]]]:
    """Minimum of shared bytes, and the position sets that index a fingerprint.

    Fingerprints that differ in k bits share at least 8 - k of their 8 bytes, so of any p
    positions they share at least p - k: every set of p - k positions out of the first p
    is one list of the index. p is the smallest with three bytes a list (20 lists for
    k = 3), so that lists stay short on large inputs.
    """
    p = min(8, max_bits + 3)
    return 8 - max_bits, list(combinations(range(p), p - max_bits))


def _byte(c: Column, i: int) -> Column:
    return F.shiftrightunsigned(c, 56 - 8 * i).bitwiseAND(255)


def linker(max_bits: int):
    """Links within the lists of the index, as the edges of a spanning forest."""
    least, _ = _prefix(max_bits)

    @F.pandas_udf(_MEMBER)
    def run(bi: pd.Series, bj: pd.Series, fps: pd.Series, blocks: pd.Series) -> pd.Series:
        out = []
        for i, j, fp, b in zip(bi, bj, fps, blocks, strict=True):
            fp = np.asarray(fp, dtype=np.int64)
            left, right = (fp, fp) if i == j else (fp[b == i], fp[b == j])
            found = []
            for at in range(0, len(left), 256):
                x = left[at : at + 256, None] ^ right[None, :]
                # tally of shared positional bytes, then the exact distance
                shared = np.zeros(x.shape, dtype=np.int8)
                for k in range(8):
                    shared += (x >> (8 * k)) & 255 == 0
                u, v = np.nonzero(shared >= least)
                d = x[u, v]
                ok = np.bitwise_count(d.view(np.uint64)) <= max_bits
                found.append(np.stack([left[at + u[ok]], right[v[ok]]], axis=1))
            e = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            out.append(forest(e[e[:, 0] != e[:, 1]]))
        return pd.Series(out)

    return run


def forest(e: np.ndarray) -> list[dict]:
    """Edges of a star for each component of the edges e."""
    if not len(e):
        return []
    nodes, ends = np.unique(e, return_inverse=True)
    ends = ends.reshape(e.shape)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[ends[:, 0]], root[ends[:, 1]])
        new = root.copy()
        for k in (0, 1):
            np.minimum.at(new, root[ends[:, k]], low)
            np.minimum.at(new, ends[:, k], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    apart = np.nonzero(root != np.arange(len(nodes)))[0]
    return [{"a": int(nodes[k]), "b": int(nodes[root[k]])} for k in apart]


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints (column fp) within `max_bits`
    differing bits: a spanning forest of each list of the index, not all of its pairs."""
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be 0 to 7")
    _, sets = _prefix(max_bits)
    keys = []
    for n, s in enumerate(sets):
        k = F.lit(n).cast("bigint")
        for i in s:
            k = F.shiftleft(k, 8).bitwiseOR(_byte(F.col("fp"), i))
        keys.append(k)
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    lists = pair_blocks(rows, "key", F.xxhash64("fp"), _LIST)
    lists = lists.select("bi", "bj", F.col("items.fp").alias("fps"), F.col("items.b").alias("blocks"))
    return lists.select(F.explode(linker(max_bits)("bi", "bj", "fps", "blocks")).alias("e")).select("e.a", "e.b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, max_bits: int = 3) -> DataFrame:
    """One row a document: id, fp (long), component_id (smallest id reachable), root (the
    least fingerprint of its component: a key of the component even where ids repeat).

    Documents with one fingerprint are one node, so copies are never expanded into pairs.
    Null and empty texts have fingerprint zero and are linked like any other; repeated
    ids are kept as rows; a component without any id has a null component_id. Columns
    other than id and text are not read, so their names cannot clash.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), n).alias("fp"))
    rows = checkpoint(rows)
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(fps.select("fp"), max_bits))
    fps = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lead = fps.groupBy("root").agg(F.min("least").alias("component_id"))
    named = checkpoint(fps.join(lead, "root").select(F.col("fp").alias("f"), "component_id", "root"))
    return rows.join(named, rows.fp == named.f).select("doc_id", "fp", "component_id", "root")
