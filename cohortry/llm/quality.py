"""Quality scores: random Fourier features of document statistics, ridge, isotonic.

Statistics of a text are standardised and mapped to cos(Wx + b) with W drawn from a normal
distribution, whose inner products approximate a Gaussian kernel. Ridge weights solve the
normal equations, which are sums over partitions; ridge scores are turned into
probabilities by isotonic regression over a histogram of labelled rows the ridge did not
see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import uniform
from cohortry.session import checkpoint

_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".?", "comma": b",;:", "bang": b"!", "bar": b"|",
    "symbol": b"#$%&*+<=>@^_`~\\/", "quote": b"\"'()[]{}-", "space": b" \t", "break": b"\n\r", "control": bytes(range(9)) + b"\x7f",
}
_MARKS = np.zeros((256, len(_GROUPS) + 1))
for _k, _chars in enumerate(_GROUPS.values()):
    _MARKS[list(_chars), _k] = 1
_MARKS[128:, len(_GROUPS)] = 1
N_STATS = len(_GROUPS) + 1 + 12
_BINS = 1024


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text; zeros for null and empty texts."""
    out = np.zeros(N_STATS)
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words, lines = text.split(), text.split("\n")
    shares = np.bincount(raw, minlength=256) @ _MARKS / len(raw)
    n, m = max(1, len(words)), len(lines)
    different, kinds = len(set(words)), len(set(lines))
    lengths = np.fromiter(map(len, words), dtype=np.int32, count=len(words)) if words else np.zeros(1, dtype=np.int32)
    upper = sum(map(str.isupper, words))
    ends = sum(1 for line in lines if line[-1:] in ".!?")
    out[: len(shares)] = np.sqrt(shares)
    out[len(shares) :] = (
        np.log1p(len(raw)), np.log1p(n), different / n, different / np.sqrt(n), np.log1p(lengths.mean()), np.log1p(lengths.std()),
        np.log1p(lengths.max()), kinds / m, np.log1p(n / m), upper / n, ends / m, (lengths <= 3).mean(),
    )
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    grid: np.ndarray
    levels: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return _features(stats, self.mean, self.scale, self.directions, self.phases) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.grid, self.levels)


def _features(stats, mean, scale, directions, phases) -> np.ndarray:
    z = np.clip((stats - mean) / scale, -6, 6)
    waves = np.cos(z @ directions + phases) * np.sqrt(2 / len(phases))
    return np.column_stack([waves, z, np.ones(len(z))])


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, N_STATS))


def isotonic(x: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing shares for sorted x by pooling neighbours that violate the order:
    the weighted centre and the share (with half an observation of each kind) per pool."""
    pools: list[list[float]] = []
    for c, k, w in zip(x, ones, n, strict=True):
        pools.append([c * w, k, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], a, strict=True)]
    t = np.array(pools)
    level = np.maximum.accumulate((t[:, 1] + 0.5) / (t[:, 2] + 1))
    return t[:, 0] / t[:, 2], level


def fit(sample: DataFrame, n_waves: int = 256, width: float = 4.0, ridge: float = 1.0, seed: int = 11) -> QualityModel:
    """Fit on (key, text, y); about four fifths of the rows, by a hash of the key, go into the
    normal equations and the others into the calibration.

    Partition sums are (features + 1)^2 numbers each and the sample is spread over 32
    partitions, so what reaches the driver is bounded. A sample without rows, or with one
    kind of label only, gives a constant score.
    """

    @F.pandas_udf("array<double>")
    def stats_of(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    rows = sample.select("y", uniform(F.col("key"), F.lit("calibrate")).alias("u"), stats_of("text").alias("s"))
    rows = checkpoint(rows.repartition(32))
    cells = rows.agg(F.count("*").alias("n"), F.avg("y").alias("p"), F.array(*(F.avg(F.col("s")[k]) for k in range(N_STATS))).alias("m"), F.array(*(F.stddev_pop(F.col("s")[k]) for k in range(N_STATS))).alias("d")).first()
    rng = np.random.default_rng(seed)
    directions, phases = rng.standard_normal((N_STATS, n_waves)) / width, rng.uniform(0, 2 * np.pi, n_waves)
    size = n_waves + N_STATS + 1
    if not cells["n"] or cells["p"] in (0.0, 1.0):
        p = float(cells["p"]) if cells["n"] else 0.5
        return QualityModel(np.zeros(N_STATS), np.ones(N_STATS), directions, phases, np.zeros(size), np.array([0.0]), np.array([p]))
    mean = np.array(cells["m"])
    scale = np.where((d := np.array(cells["d"])) > 1e-9, d, 1.0)

    def sums(batches):
        total = np.zeros((size, size + 1))
        for b in batches:
            if len(b):
                z = _features(_stack(b["s"]), mean, scale, directions, phases)
                total += z.T @ np.column_stack([z, b["y"].to_numpy(dtype=float)])
        yield pd.DataFrame({"t": [total.tobytes()]})

    parts = rows.where("u >= 0.2").select("y", "s").mapInPandas(sums, "t binary").collect()
    total = sum(np.frombuffer(r["t"]).reshape(size, size + 1) for r in parts)
    weights = np.linalg.solve(total[:, :size] + ridge * np.eye(size), total[:, size])
    base = QualityModel(mean, scale, directions, phases, weights, np.array([0.0]), np.array([0.5]))

    @F.pandas_udf("double")
    def raw(stats: pd.Series) -> pd.Series:
        return pd.Series(base.raw(_stack(stats)))

    held = rows.where("u < 0.2").select("y", raw("s").alias("r"))
    bins = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("r") + 0.5) / 2)) * _BINS)
    table = held.groupBy(bins.alias("bin")).agg(F.avg("r").alias("x"), F.sum("y").alias("k"), F.count("*").alias("n")).orderBy("bin").collect()
    if not table:
        return QualityModel(mean, scale, directions, phases, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    grid, levels = isotonic(*(np.array([float(r[c]) for r in table]) for c in ("x", "k", "n")))
    return QualityModel(mean, scale, directions, phases, weights, grid, levels)


def score(model: QualityModel, text: Column) -> Column:
    """Probability of label 1 of each whole text, empty and null texts included."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([statistics(t) for t in texts])) if len(texts) else np.zeros(0))

    return run(text.cast("string"))
