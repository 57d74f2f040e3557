"""Exact top-k by inner product, as a Voronoi kNN join.

Vectors are dealt into cells by their nearest pivot (Euclidean), and each cell keeps a
summary: its pivot p, its radius r (largest distance of a member from p) and its count.
For a query q every member x of cell c scores within q.p +- |q| r. A query sorts the
cells by that lower bound and adds their counts until k + 1 members are certain (one may
be the query's own row): the bound reached there is at most its k-th best score. Cells
whose upper bound stays below it cannot hold a member of the answer and are left out;
only the rest of the data meets the query. Each needed cell is solved locally, as
blocks of queries against blocks of members, with one matrix product each.

Exact copies of a vector are one member with the smallest ids of its copies, so a large
group of copies costs as much as one vector.

Rows: `id_col` (long) and `vec_col` (array of numbers). Components become
floor(scale * x), x as a double; scores are integer inner products of the same length.

Defined results:
- vectors that are null, hold a null or non-finite component, or whose integer squared
  norm reaches 2^62 (the score could leave a long) take no part, as query or candidate;
- candidates are all other rows of the same dimension; a query's own row is never its
  candidate, another row with the same id and vector is;
- ties of score go to the smaller id, then to the row read first;
- fewer than k candidates: all of them; no candidate: no row; an empty table: no row;
- null ids are candidates and sort last among ties; a null id is not a query;
- other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.llm.common import uniform
from cohortry.session import checkpoint

#: Cells at most; pivots are drawn from a hash-ordered sample of valid vectors.
PIVOTS = 256
#: Members of one block of a cell, and queries of one block of queries.
BLOCK = 4096
QUERY_BLOCK = 1024
#: Vectors whose integer squared norm reaches this could score beyond a long.
_LIMIT = 2.0**62


def _id(i):
    return None if i is None or (isinstance(i, float) and np.isnan(i)) else int(i)


def integer_vectors(rows: DataFrame, scale: float) -> DataFrame:
    """The valid rows of (row, id, x, ...) with `v` (array of longs) and `dim`."""
    x = F.col("x")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    v = F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("double"))
    out = rows.where(x.isNotNull() & ~bad).withColumn("v", v)
    sq = F.aggregate(F.col("v"), F.lit(0.0), lambda a, e: a + e * e)
    return out.where(sq < _LIMIT).withColumn("v", F.transform("v", lambda e: e.cast("long"))).withColumn("dim", F.size("v")).drop("x")


def _nearest(pivots: dict[int, np.ndarray], ids: dict[int, np.ndarray]):
    """Cell and distance of each vector: the nearest pivot of its dimension, else cell -1."""

    def run(batches):
        for b in batches:
            cell = np.full(len(b), -1, dtype=np.int64)
            dist = np.zeros(len(b))
            dims = b["dim"].to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if int(d) not in pivots:
                    continue
                m = np.vstack(b["v"].iloc[at].to_numpy()).astype(np.float64) if d else np.zeros((len(at), 0))
                p = pivots[int(d)]
                d2 = (m * m).sum(1)[:, None] - 2 * m @ p.T + (p * p).sum(1)[None, :]
                j = d2.argmin(1)
                cell[at] = ids[int(d)][j]
                dist[at] = np.sqrt(np.maximum(d2[np.arange(len(at)), j], 0))
            yield b.assign(cell=cell, dist=dist)[["key", "cell", "dist"]]

    return run


def _bounds(pivots, ids, cells: pd.DataFrame, k: int):
    """(query row, cell) of every cell that may hold one of the query's k best."""
    stats = {int(c): (int(n), float(r)) for c, n, r in cells[["cell", "n", "r"]].itertuples(index=False)}

    def run(batches):
        for b in batches:
            out_q, out_c = [], []
            for key, vec, dim, own in b[["key", "v", "dim", "cell"]].itertuples(index=False):
                q = np.asarray(vec, dtype=np.float64)
                nq = float(np.sqrt(q @ q))
                cs, ub, lb, n = [], [], [], []
                if int(dim) in pivots:
                    p = pivots[int(dim)]
                    dot = p @ q
                    for j, c in enumerate(ids[int(dim)].tolist()):
                        if c in stats:
                            cnt, r = stats[c]
                            cs.append(c), ub.append(dot[j] + nq * r), lb.append(dot[j] - nq * r), n.append(cnt - (c == own))
                if -1 in stats:  # vectors without a pivot of their dimension: never pruned
                    cs.append(-1), ub.append(np.inf), lb.append(-np.inf), n.append(stats[-1][0] - (own == -1))
                lb_a, n_a = np.asarray(lb), np.asarray(n)
                order = np.argsort(-lb_a, kind="stable")
                reach = np.cumsum(n_a[order])
                enough = np.flatnonzero(reach >= k)
                theta = lb_a[order[enough[0]]] if len(enough) else -np.inf
                # scores are integers: a margin of one covers rounding of the bounds
                need = [c for c, u in zip(cs, ub, strict=True) if u + 1 + 1e-9 * abs(u) >= theta - 1]
                out_q += [key] * len(need)
                out_c += need
            yield pd.DataFrame({"key": np.asarray(out_q, dtype=np.int64), "cell": np.asarray(out_c, dtype=np.int64)})

    return run


def _solve(k: int):
    """Best k of each query row within one block of a cell."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        qs, xs = g[g["side"] == 0], g[g["side"] == 1]
        cols = {"key": [], "query_id": [], "id": [], "first": [], "score": []}
        if len(qs) and len(xs):
            for dim in np.unique(qs["dim"].to_numpy()):
                q = qs[qs["dim"] == dim]
                x = xs[xs["dim"] == dim]
                if not len(x):
                    continue
                qm = np.vstack(q["v"].to_numpy()).astype(np.int64) if dim else np.zeros((len(q), 0), np.int64)
                xm = np.vstack(x["v"].to_numpy()).astype(np.int64) if dim else np.zeros((len(x), 0), np.int64)
                s = qm @ xm.T
                # each member stands for up to k + 1 rows of identical vectors
                members = [[(int(a), _id(b)) for a, b in zip(r, i, strict=True)] for r, i in zip(x["rows"], x["ids"], strict=True)]
                for a, (key, qid) in enumerate(zip(q["key"].tolist(), q["id"].tolist(), strict=True)):
                    row = s[a]
                    top = np.argsort(-row, kind="stable")
                    found = []
                    for b in top:
                        if len(found) >= k and row[b] < found[k - 1][0]:
                            break
                        for r, i in members[b]:
                            if r != key:
                                found.append((int(row[b]), i, r))
                        found.sort(key=lambda t: (-t[0], t[1] is None, t[1] if t[1] is not None else 0, t[2]))
                    for sc, i, r in found[:k]:
                        cols["key"].append(key), cols["query_id"].append(_id(qid)), cols["id"].append(i)
                        cols["first"].append(r), cols["score"].append(sc)
        return pd.DataFrame(
            {
                "key": pd.array(cols["key"], dtype="Int64"), "query_id": pd.array(cols["query_id"], dtype="Int64"),
                "id": pd.array(cols["id"], dtype="Int64"), "first": pd.array(cols["first"], dtype="Int64"),
                "score": pd.array(cols["score"], dtype="Int64"),
            }
        )

    return run


def top_k(
    df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, n_pivots: int = PIVOTS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query row.

    `queries` is a condition on the input's columns that marks the query rows (null: no).
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    vecs = integer_vectors(rows, scale)
    # copies of a vector are one member holding its k + 1 first rows; the limit is taken
    # on both sides of the exchange, so a large group of copies is never gathered
    w = Window.partitionBy("dim", "v").orderBy(F.col("id").asc_nulls_last(), "row")
    firsts = vecs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    members = firsts.groupBy("dim", "v").agg(
        F.min("row").alias("mkey"), F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("z"), "id", "row"))).alias("m")
    ).select("mkey", "dim", "v", F.col("m.row").alias("rows"), F.col("m.id").alias("ids"))
    members = checkpoint(members)
    n_members = members.count()
    if n_members == 0:
        return _empty(df.sparkSession)
    frac = min(1.0, 4.0 * n_pivots / n_members)
    sample = members.where(uniform(F.col("mkey"), F.lit("pivot")) < frac).orderBy(uniform(F.col("mkey"), F.lit("order")), "mkey").limit(n_pivots)
    pivots, ids = {}, {}
    for j, r in enumerate(sample.select("dim", "v").collect()):  # n_pivots rows at most
        pivots.setdefault(r["dim"], []).append(np.asarray(r["v"], dtype=np.float64))
        ids.setdefault(r["dim"], []).append(j)
    pivots = {d: np.vstack(p) if d else np.zeros((len(p), 0)) for d, p in pivots.items()}
    ids = {d: np.asarray(i, dtype=np.int64) for d, i in ids.items()}

    placed = "cell long, dist double"
    assigned = members.withColumnRenamed("mkey", "key").mapInPandas(_nearest(pivots, ids), f"key long, {placed}")
    assigned = checkpoint(members.join(assigned.withColumnRenamed("key", "mkey"), "mkey"))
    cells = assigned.groupBy("cell").agg(F.sum(F.size("rows")).alias("n"), F.max("dist").alias("r"), F.count("*").alias("members"))
    cells = cells.toPandas()  # one row per cell: n_pivots + 1 at most

    asked = vecs.where("is_query").select(F.col("row").alias("key"), "id", "v", "dim")
    own = asked.mapInPandas(_nearest(pivots, ids), f"key long, {placed}").select("key", F.col("cell").alias("own"))
    needed = asked.join(own, "key").withColumnRenamed("own", "cell")
    needed = needed.mapInPandas(_bounds(pivots, ids, cells, k), "key long, cell long")
    needed = checkpoint(asked.join(needed, "key"))

    # blocks of members and of queries per cell: a hot cell is solved by many tasks
    spark = df.sparkSession
    q_per_cell = needed.groupBy("cell").count().toPandas()  # n_pivots + 1 rows at most
    plan = cells[["cell", "members"]].merge(q_per_cell, on="cell", how="inner")
    plan = spark.createDataFrame(
        pd.DataFrame({"cell": plan["cell"].astype("int64"), "nb": -(-plan["members"] // BLOCK).astype("int64"), "nq": -(-plan["count"] // QUERY_BLOCK).astype("int64")}),
        "cell long, nb long, nq long",
    )
    data = assigned.join(F.broadcast(plan), "cell").select(
        "cell", F.pmod(F.xxhash64("mkey"), F.col("nb")).alias("db"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("qb"),
        F.lit(1).alias("side"), F.col("mkey").alias("key"), F.lit(None).cast("long").alias("id"), "v", "dim", "rows", "ids",
    )
    ask = needed.join(F.broadcast(plan), "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("db"), F.pmod(F.xxhash64("key"), F.col("nq")).alias("qb"),
        F.lit(0).alias("side"), "key", "id", "v", "dim", F.array().cast("array<long>").alias("rows"), F.array().cast("array<long>").alias("ids"),
    )
    best = data.unionByName(ask).groupBy("cell", "db", "qb").applyInPandas(_solve(k), "key long, query_id long, id long, first long, score long")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "first"))
    out = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _empty(spark) -> DataFrame:
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
