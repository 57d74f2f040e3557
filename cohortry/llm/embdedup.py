"""Near-duplicate vectors by cosine, from binary codes of randomly rotated vectors.

A unit vector o is rotated and reduced to its signs, the code u = sign(o) / sqrt(d). The
factor f = <u, o> is stored with it. For any unit vector q, <u, q> / f estimates <o, q>
without bias, and <o, q> <= f <u, q> + sqrt(1 - f^2) sqrt(1 - <u, q>^2) always holds.
Pairs whose bound stays below the threshold are settled by it; the others are computed
again exactly.

Candidates come from the same codes. Unit vectors with cosine >= t are at most r apart,
r^2 = 2 - 2t, so in one of the m blocks of their coordinates they are at most r/sqrt(m)
apart. Where signs differ in that block, the sum of (|x_i| + |y_i|)^2 is at most r^2/m,
so if each side flips the coordinates in which it is the smaller, the squares it flips sum
to r^2/4m at most. A vector listed under every code of a block that it reaches by flipping
so little meets each of its partners in at least one list. That bound is for the worst
direction of x - y; after a random rotation the sums are far smaller, and `reach` sets the
share of the bound that is listed. At reach 0.15 and 64 dimensions a vector is in about 40
lists (460 at reach 1), and of random pairs with a cosine of exactly 0.95 about 7 in
100,000 meet in none of the four blocks; at 0.97 none of 200,000 did. Vectors with fewer
than four blocks (under 56 dimensions) are always listed to the whole bound.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import components, pair_blocks
from cohortry.llm.simhash import forest
from cohortry.session import checkpoint

_LIST = 1024
_SLACK = 1e-9
_KINDS = {"float": "<f4", "double": "<f8"}


@functools.cache
def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(1000 + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def spans(d: int) -> list[tuple[int, int]]:
    """The blocks of coordinates, about 16 in each."""
    cuts = np.linspace(0, d, max(1, round(d / 16)) + 1).astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def flips(squares: np.ndarray, budget: float) -> list[int]:
    """Every set of positions (as bits) whose squares sum to the budget at most."""
    order = [int(k) for k in np.argsort(squares) if squares[k] <= budget]
    out, stack = [], [(0, 0, 0.0)]
    while stack:
        at, mask, cost = stack.pop()
        out.append(mask)
        for k in range(at, len(order)):
            more = cost + squares[order[k]]
            if more > budget:
                break
            stack.append((k + 1, mask | 1 << order[k], more))
    return out


def _bits(positive: np.ndarray) -> np.ndarray:
    return (positive.astype(np.int64) << np.arange(positive.shape[-1])).sum(axis=-1)


def _budget(threshold: float, blocks: int, reach: float) -> float:
    # with fewer than four blocks a pair has too few chances to meet; list the whole bound
    return (reach if blocks >= 4 else 1) * (2 - 2 * threshold) / (4 * blocks)


def packer(kind: str, threshold: float, reach: float):
    """vector -> (vec, code, factor, keys, flipped): null for vectors that link with nothing."""

    @F.pandas_udf("vec binary, code binary, factor double, keys array<struct<key:bigint,flipped:bigint>>")
    def run(vectors: pd.Series) -> pd.DataFrame:
        rows = []
        for v in vectors:
            x = None if v is None else np.array([np.nan if c is None else c for c in v] if getattr(v, "dtype", None) == object else v, dtype=kind) + 0
            # scaled by the largest component first, so that no square leaves the doubles
            top = 0.0 if x is None or not len(x) or not np.isfinite(x).all() else float(np.abs(x.astype(np.float64)).max())
            if top == 0:
                rows.append((None, None, None, None))
                continue
            d = len(x)
            xs = x.astype(np.float64) / top
            o = rotation(d) @ (xs / np.linalg.norm(xs))
            blocks = spans(d)
            budget = _budget(threshold, len(blocks), reach) + _SLACK
            keys = []
            for j, (s, e) in enumerate(blocks):
                own, head = int(_bits(o[s:e] >= 0)), (d << 48) | (j << 32)
                keys += [{"key": head | (own ^ m), "flipped": m} for m in flips(o[s:e] ** 2, budget)]
            rows.append((x.tobytes(), np.packbits(o >= 0).tobytes(), float(np.abs(o).sum() / np.sqrt(d)), keys))
        return pd.DataFrame(rows, columns=["vec", "code", "factor", "keys"])

    return run


def pairs_in(key: int, x: np.ndarray, codes: np.ndarray, f: np.ndarray, flipped: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, reach: float, epsilon: float | None):
    """Linked pairs (u, v) of one list that are counted in this list and in no other."""
    d = x.shape[1]
    x = x / np.abs(x).max(axis=1, keepdims=True)  # cosines are kept, squares stay finite
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    o = unit @ rotation(d).T
    signs = (np.unpackbits(codes, axis=1, count=d).astype(np.float64) * 2 - 1) / np.sqrt(d)
    blocks, found = spans(d), []
    here = (key >> 32) & 0xFFFF
    budget = _budget(threshold, len(blocks), reach) + _SLACK / 2
    same = left is right
    for at in range(0, len(left), 256):
        a = left[at : at + 256]
        open_ = (flipped[a][:, None] & flipped[right][None, :]) == 0
        if same:
            open_ &= np.arange(at, at + len(a))[:, None] < np.arange(len(right))[None, :]
        if not open_.any():
            continue
        e = np.clip(o[a] @ signs[right].T, -1, 1)
        fr = f[right][None, :]
        if epsilon is None:
            bound = fr * e + np.sqrt(np.maximum(0, 1 - fr**2)) * np.sqrt(1 - e**2)
        else:
            bound = e / fr + epsilon * np.sqrt(np.maximum(0, 1 - fr**2)) / fr / np.sqrt(max(1, d - 1))
        us, vs = np.nonzero(open_ & (bound >= threshold - _SLACK))
        for k in range(0, len(us), 16384):
            u, v = a[us[k : k + 16384]], right[vs[k : k + 16384]]
            dot = np.einsum("ij,ij->i", x[u], x[v])
            ok = dot / (np.linalg.norm(x[u], axis=1) * np.linalg.norm(x[v], axis=1)) >= threshold
            u, v = u[ok], v[ok]
            # each differing coordinate must be flipped by the smaller side, and no
            # earlier block may join the pair
            first = np.full(len(u), -1)
            for j, (s, t) in enumerate(blocks[: here + 1]):
                p, q = o[u, s:t], o[v, s:t]
                differ = (p >= 0) != (q >= 0)
                small = np.abs(p) < np.abs(q)
                cost = np.maximum(np.where(differ & small, p**2, 0).sum(axis=1), np.where(differ & ~small, q**2, 0).sum(axis=1))
                first = np.where((first < 0) & (cost <= budget), j, first)
                if j == here:
                    right_flips = (_bits(differ & small) == flipped[u]) & (_bits(differ & ~small) == flipped[v])
            ok = (first == here) & right_flips
            found.append(np.stack([u[ok], v[ok]], axis=1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def linker(kind: str, threshold: float, reach: float, epsilon: float | None):
    """Per list: (id, links found here, a parent in the same component) of its members."""

    @F.pandas_udf("array<struct<id:bigint,n:bigint,parent:bigint>>")
    def run(key: pd.Series, bi: pd.Series, bj: pd.Series, items: pd.DataFrame) -> pd.Series:
        out = []
        for k, i, j, b, ids, many, vec, code, f, flipped in zip(key, bi, bj, *(items[c] for c in ("b", "id", "many", "vec", "code", "factor", "flipped")), strict=True):
            n = len(ids)
            x = np.frombuffer(b"".join(vec), dtype=kind).reshape(n, -1).astype(np.float64)
            codes = np.frombuffer(b"".join(code), dtype=np.uint8).reshape(n, -1)
            left = np.nonzero(b == i)[0]
            right = left if i == j else np.nonzero(b == j)[0]
            p = pairs_in(int(k), x, codes, np.asarray(f), np.asarray(flipped), left, right, threshold, reach, epsilon)
            if not len(p):
                out.append([])
                continue
            ids, many = np.asarray(ids), np.asarray(many, dtype=np.float64)
            count = np.bincount(p[:, 0], many[p[:, 1]], n) + np.bincount(p[:, 1], many[p[:, 0]], n)
            star = {x["a"]: x["b"] for x in forest(ids[p[ids[p[:, 0]] != ids[p[:, 1]]]])}
            out.append([{"id": int(ids[t]), "n": int(count[t]), "parent": star.get(int(ids[t]), int(ids[t]))} for t in np.nonzero(count)[0]])
        return pd.Series(out)

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, reach: float = 0.15, epsilon: float | None = None
) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    `reach` is the share of the candidate bound that is listed; 1 loses no link. In the
    lists the default bound always holds. With `epsilon` the narrower confidence bound
    estimate + epsilon * sqrt((1 - f^2) / (f^2 (d - 1))) decides instead, and links may be
    missed with the small probability it stands for.

    Equal vectors are one class with a multiplicity, so copies are never compared, and
    lists hold classes. Null, empty and zero vectors and those with null or non-finite
    components link with nothing (n_links 0, own component). Vectors of different lengths
    are not compared. Every distinct vector is a node of its own: rows that share an id but
    not a vector are linked only through their vectors. Vectors with null ids are listed
    and linked like any other; a null id never names a component (a component of null ids
    only has a null component_id, and its rows count as kept). Vectors are scaled by their
    largest component before norms are taken, so finite vectors of any size are compared.
    Other columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    kind = _KINDS[vectors.schema[vector_col].dataType.elementType.typeName()]
    rows = vectors.select(F.col(id_col).alias("vec_id"), packer(kind, threshold, reach)(F.col(vector_col)).alias("p"))
    rows = checkpoint(rows.select("vec_id", "p.*"))
    classes = (
        rows.where(F.col("vec").isNotNull()).groupBy("vec")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("many"), F.first("code").alias("code"), F.first("factor").alias("factor"), F.first("keys").alias("keys"))
    )
    # every distinct vector is a node of its own, whatever ids it carries
    classes = checkpoint(classes.withColumn("node", F.monotonically_increasing_id()))
    listed = classes.select(F.col("node").alias("id"), "many", "vec", "code", "factor", F.explode("keys").alias("k"))
    listed = listed.select("id", "many", "vec", "code", "factor", F.col("k.key").alias("key"), F.col("k.flipped").alias("flipped"))
    lists = pair_blocks(listed, "key", F.xxhash64("vec"), _LIST)
    items = F.struct(*(F.col(f"items.{c}").alias(c) for c in ("b", "id", "many", "vec", "code", "factor", "flipped")))
    met = lists.select(F.explode(linker(kind, threshold, reach, epsilon)("key", "bi", "bj", items)).alias("m"))
    met = checkpoint(met.select("m.*"))
    roots = components(met.select(F.col("id").alias("a"), F.col("parent").alias("b")))
    counts = met.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "node")
    comp = classes.select("node", F.col("id").alias("least")).join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    lead = comp.groupBy("root").agg(F.min("least").alias("component_id"))
    named = (
        classes.select(F.col("vec").alias("v"), "node", "many").join(counts, "node", "left").join(comp.select("node", "root"), "node").join(lead, "root")
        .select("v", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    )
    out = rows.select("vec_id", "vec").join(named, F.col("vec") == F.col("v"), "left")
    out = out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
