"""Patient cohorts: k-means, density clustering and cohort profiles."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.numeric import numeric_columns, string_columns
from cohortry.operators.preprocess import long_form
from cohortry.operators.ranks import global_rank
from cohortry.session import checkpoint


PAIR_LIMIT = 1_000_000  # point pairs a pair of boxes may compare
ROWS_A_TASK = 1_000_000  # rows a task of k-means passes over
KEY_DIMS = 3  # leading dimensions by which neighbours are looked up


def kmeans_cohorts(emb: DataFrame, id_col: str, k: int = 5, n_init: int = 10, seed: int = 42, vec: str = "vec") -> DataFrame:
    """id, cohort: the cheapest of several seeded k-means runs."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    # every step of every run sends a result per partition to the driver: no more
    # partitions than cores and rows ask for, whatever the exchanges below are set to
    cores = emb.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-emb.count() // ROWS_A_TASK))
    v = emb.select(id_col, array_to_vector(vec).alias("features")).coalesce(parts).persist()
    fits = [KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cohort").fit(v) for i in range(n_init)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    v.unpersist()
    return best.transform(v).select(id_col, "cohort")


def _squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _cell(vec: str, d: int, side: float) -> Column:
    return F.array(*[F.floor(F.element_at(vec, j + 1) / F.lit(side)).cast("bigint") for j in range(d)])


def dbscan(
    emb: DataFrame, id_col: str, eps: float = 0.5, min_samples: int = 5, vec: str = "vec", pair_limit: int = PAIR_LIMIT
) -> DataFrame:
    """id, cohort: density clusters, noise -1, clusters numbered by their lowest core id.

    Space is cut into cells of diagonal eps, so all points of a cell are neighbours:
    a cell with `min_samples` points is all core, and the cores of one cell belong
    together. Only points of sparse cells count neighbours, and components run over
    cells, not over point pairs: a hot cell is one node whatever its size. Two cells
    with core points are linked when some cores of them lie within eps, which boxes
    settle before points are compared (`_cell_links`). Copies are collapsed first.

    Any number of dimensions will do: neighbours are looked up on a coarse grid over the
    first `KEY_DIMS` of them (after a projection those of the largest variance), which
    loses none, and are then told by their distance in all. Ids are numbers or texts.
    """
    first = emb.select(F.size(vec).alias("d")).first()
    if first is None:
        return emb.select(id_col, F.lit(-1).cast("bigint").alias("cohort"))
    d = first["d"]
    side = eps / d**0.5 * (1 - 1e-12)
    pts = emb.select(F.col(id_col).alias("id"), F.col(vec).alias("vec")).withColumn("cell", _cell("vec", d, side))
    # distinct positions with their weight
    pos = checkpoint(pts.groupBy("cell", "vec").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("low")))
    sizes = pos.groupBy("cell").agg(F.sum("w").alias("cell_n"))
    # corners of cells with points within eps differ by less than this in each dimension
    width = (eps + side) * (1 + 1e-9)

    def keyed(df: DataFrame, cell: str) -> DataFrame:
        """Adds the coarse grid cell as the columns k0, k1, ..."""
        return df.withColumns({f"k{j}": F.floor(F.element_at(cell, j + 1) * F.lit(side / width)) for j in range(min(d, KEY_DIMS))})

    keys = [f"k{j}" for j in range(min(d, KEY_DIMS))]

    def around(df: DataFrame) -> DataFrame:
        """One row per coarse cell next to the own one."""
        df = keyed(df, "cell")
        for k in keys:
            df = df.withColumn(k, F.explode(F.array(F.col(k) - 1, F.col(k), F.col(k) + 1)))
        return df

    limit = F.lit(eps * eps * (1 + 1e-12))
    # sparse cells: weigh the neighbours of each position
    marked = pos.join(sizes, "cell")
    sparse = around(marked.filter(F.col("cell_n") < min_samples).select("cell", "vec"))
    other = keyed(pos.select(F.col("cell").alias("ncell"), F.col("vec").alias("nvec"), "w"), "ncell")
    counts = (
        sparse.join(other, keys).filter(_squared_distance(F.col("vec"), F.col("nvec")) <= limit)
        .groupBy("cell", "vec").agg(F.sum("w").alias("nn"))
    )
    sparse_core = counts.filter(F.col("nn") >= min_samples).select("cell", "vec")
    dense_core = marked.filter(F.col("cell_n") >= min_samples).select("cell", "vec")
    core = checkpoint(dense_core.unionByName(sparse_core).join(pos.select("cell", "vec", "low"), ["cell", "vec"]))
    nodes = core.groupBy("cell").agg(F.min("low").alias("label"))
    # links between cells that hold cores
    steps = F.zip_with("cell", "ncell", lambda a, b: F.greatest(F.abs(a - b) - 1, F.lit(0)) * F.lit(side))
    gap = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x * x)
    cells = around(nodes.select("cell")).join(keyed(nodes.select(F.col("cell").alias("ncell")), "ncell"), keys)
    cells = cells.filter((F.col("cell") < F.col("ncell")) & (gap <= limit)).select("cell", "ncell")
    links = _cell_links(cells, core.select("cell", "vec"), d, side, eps, pair_limit)
    links = checkpoint(links.unionByName(links.select(F.col("ncell").alias("cell"), F.col("cell").alias("ncell"))))
    labels = connected_labels(nodes, links)
    # borders join the lowest cluster in reach
    core_l = core.join(labels, "cell").select("cell", "vec", "label")
    rest = pos.select("cell", "vec").join(core.select("cell", "vec"), ["cell", "vec"], "left_anti")
    target = keyed(core_l.select(F.col("cell").alias("ncell"), F.col("vec").alias("nvec"), "label"), "ncell")
    border = (
        around(rest).join(target, keys).filter(_squared_distance(F.col("vec"), F.col("nvec")) <= limit)
        .groupBy("cell", "vec").agg(F.min("label").alias("label"))
    )
    found = core_l.unionByName(border.select("cell", "vec", "label"))
    roots = labels.select("label").distinct()
    numbered = global_rank(roots, ["label"], out="n").select("label", (F.col("n") - 1).alias("cohort"))
    out = pts.join(found.join(numbered, "label").select("cell", "vec", "cohort"), ["cell", "vec"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("cohort", F.lit(-1)).cast("bigint").alias("cohort"))


def _cell_links(cells: DataFrame, core: DataFrame, d: int, side: float, eps: float, pair_limit: int) -> DataFrame:
    """Pairs of cells (cell, ncell) with two cores within eps, each pair once.

    A pair of boxes whose farthest corners lie within eps is linked outright, one
    whose nearest faces lie beyond eps is dropped. What stays open is compared point
    by point when the product of its counts is small, and cut into finer boxes
    otherwise, so two hot cells never meet point by point as a whole."""
    limit = eps * eps * (1 + 1e-12)
    sized = core.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    open_pairs = (
        cells.join(sized, "cell")
        .join(sized.select(F.col("cell").alias("ncell"), F.col("n").alias("m")), "ncell")
        .select("cell", "ncell", F.col("cell").alias("a"), F.col("ncell").alias("b"), "n", "m")
    )
    found = None
    for level in count():  # copies are collapsed, so boxes end up with one position each
        open_pairs = checkpoint(open_pairs)
        boxed = core.withColumn("box", _cell("vec", d, side / 2**level))
        small = open_pairs.filter(F.col("n") * F.col("m") <= pair_limit).select("cell", "ncell", "a", "b")
        pa = boxed.select("cell", F.col("box").alias("a"), "vec")
        pb = boxed.select(F.col("cell").alias("ncell"), F.col("box").alias("b"), F.col("vec").alias("nvec"))
        close = small.join(pa, ["cell", "a"]).join(pb, ["ncell", "b"]).filter(_squared_distance(F.col("vec"), F.col("nvec")) <= F.lit(limit))
        hit = close.select("cell", "ncell").distinct()
        big = open_pairs.filter(F.col("n") * F.col("m") > pair_limit)
        if big.isEmpty():
            return hit if found is None else found.unionByName(hit).distinct()
        # halve the boxes of what is too big to compare
        finer = side / 2 ** (level + 1)
        parts = boxed.groupBy("cell", "box", _cell("vec", d, finer).alias("part")).agg(F.count(F.lit(1)).alias("c"))
        left = parts.select("cell", F.col("box").alias("a"), F.col("part").alias("a2"), F.col("c").alias("n2"))
        right = parts.select(F.col("cell").alias("ncell"), F.col("box").alias("b"), F.col("part").alias("b2"), F.col("c").alias("m2"))
        steps = F.zip_with("a2", "b2", lambda x, y: F.abs(x - y))
        near = F.aggregate(F.transform(steps, lambda x: F.greatest(x - 1, F.lit(0)) * F.lit(finer)), F.lit(0.0), lambda t, x: t + x * x)
        far = F.aggregate(F.transform(steps, lambda x: (x + 1) * F.lit(finer)), F.lit(0.0), lambda t, x: t + x * x)
        fine = big.select("cell", "ncell", "a", "b").join(left, ["cell", "a"]).join(right, ["ncell", "b"])
        fine = fine.select("cell", "ncell", F.col("a2").alias("a"), F.col("b2").alias("b"), F.col("n2").alias("n"), F.col("m2").alias("m"), near.alias("near"), far.alias("far"))
        fine = checkpoint(fine.filter(F.col("near") <= F.lit(limit)))
        sure = fine.filter(F.col("far") <= F.lit(eps * eps)).select("cell", "ncell").distinct()
        fresh = hit.unionByName(sure).distinct()
        found = checkpoint(fresh if found is None else found.unionByName(fresh).distinct())
        open_pairs = fine.drop("near", "far").join(found, ["cell", "ncell"], "left_anti")


def connected_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """cell, label: smallest label of each component. Every round takes the smallest
    label among the neighbours and then jumps to the label of that label's owner, so
    long chains shorten quickly; state is checkpointed between rounds."""
    state = checkpoint(nodes.select("cell", "label", F.col("label").alias("own")))
    while True:
        seen = links.join(state.select(F.col("cell").alias("ncell"), F.col("label").alias("nlabel")), "ncell")
        best = seen.groupBy("cell").agg(F.min("nlabel").alias("nlabel"))
        new = state.join(best, "cell", "left").select(
            "cell", "own", F.col("label").alias("old"), F.least("label", F.coalesce("nlabel", "label")).alias("label")
        )
        owner = new.select(F.col("own").alias("label"), F.col("label").alias("jump"))
        new = new.join(owner, "label", "left").select(
            "cell", "own", "old", F.least(F.col("label"), F.coalesce("jump", "label")).alias("label")
        )
        new = checkpoint(new)
        if new.filter(F.col("label") != F.col("old")).isEmpty():
            return new.select("cell", "label")
        state = new.select("cell", "label", "own")


def cohort_profiles(df: DataFrame, cohort: str, id_col: str) -> DataFrame:
    """Long profile of each cohort: size, mean and std of numbers, mode of texts.
    Noise (-1) is left out."""
    rows = df.filter(F.col(cohort) != -1)
    nums = numeric_columns(df, [cohort, id_col])
    texts = string_columns(df, [id_col])
    key = F.col(cohort).alias("cohort")
    base = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"{c}_mean") for c in nums],
        *[F.stddev_samp(c).alias(f"{c}_std") for c in nums],
    )
    stats = ["n"] + [f"{c}_{s}" for c in nums for s in ("mean", "std")]
    cells = [
        F.struct(F.lit("size" if c == "n" else c).alias("characteristic"), F.col(c).cast("double").alias("number"), F.lit(None).cast("string").alias("mode"))
        for c in stats
    ]
    out = base.select("cohort", F.inline(F.array(*cells)))
    if texts:
        counts = long_form(rows, texts, "string", [cohort]).groupBy(key, "feature", "v").agg(F.count(F.lit(1)).alias("n"))
        best = F.min_by("v", F.when(F.col("v").isNotNull(), F.struct(-F.col("n"), F.col("v"))))
        modes = counts.groupBy("cohort", "feature").agg(F.coalesce(best, F.lit("unknown")).alias("mode"))
        out = out.unionByName(
            modes.select("cohort", F.concat("feature", F.lit("_mode")).alias("characteristic"), F.lit(None).cast("double").alias("number"), "mode")
        )
    return out
