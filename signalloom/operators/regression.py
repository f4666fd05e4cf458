"""Least squares from moments.

One aggregate a segment gives means and covariances (stable partial sums); every model of
the same columns, on the train part or judged on the test part, follows from these few
numbers, so the rows are passed once whatever the number of models.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import fisher_p, student_p

SUMMARY = [
    "train_r2_base", "train_r2_joint", "train_incremental_r2", "train_block_f", "train_block_f_p", "stage2_residual_r2",
    "oos_r2_base", "oos_r2_joint", "oos_incremental_r2", "oos_corr_base", "oos_corr_joint",
]


def moments(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """``by, n, mean, cov`` of the rows that have all columns; covariances over n, row by row of the upper triangle."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    known = df.select(by, *(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    return known.groupBy(by).agg(F.count("*").alias("n"), F.array(*(F.avg(c) for c in columns)).alias("mean"), F.array(*(F.covar_pop(a, b) for a, b in pairs)).alias("cov"))


class Moments:
    """Means and covariances of one segment; column 0 is the target."""

    def __init__(self, row: dict):
        self.n, self.mean = row["n"], np.array(row["mean"], float)
        k = len(self.mean)
        self.cov = np.zeros((k, k))
        self.cov[np.triu_indices(k)] = row["cov"]
        self.cov = self.cov + np.triu(self.cov, 1).T

    def fit(self, x: list[int]) -> tuple[float, np.ndarray]:
        """Intercept and slopes of the target on some columns; the shortest solution where they depend on each other."""
        b = np.linalg.pinv(self.cov[np.ix_(x, x)], hermitian=True) @ self.cov[x, 0]
        return float(self.mean[0] - self.mean[x] @ b), b

    def error(self, x: list[int], a: float, b: np.ndarray) -> float:
        """Sum of squared errors of a model here, wherever it was fitted."""
        bias = self.mean[0] - a - self.mean[x] @ b
        return float(self.n * (bias**2 + self.cov[0, 0] - 2 * b @ self.cov[x, 0] + b @ self.cov[np.ix_(x, x)] @ b))

    def total(self, mean: float | None = None) -> float:
        """Sum of squares of the target around its own or a given mean."""
        return float(self.n * (self.cov[0, 0] + (0.0 if mean is None else (self.mean[0] - mean) ** 2)))

    def corr(self, x: list[int], b: np.ndarray) -> float:
        spread = b @ self.cov[np.ix_(x, x)] @ b * self.cov[0, 0]
        return float(b @ self.cov[x, 0] / spread**0.5) if spread > 0 else float("nan")


def _ratio(a: float, b: float) -> float:
    return a / b if b else float("nan")


def analyse(parts: dict[str, Moments], n_base: int, n_extra: int) -> dict:
    """All figures of the base model, the model of its residuals and the joint one."""
    train, test = parts.get("train"), parts.get("test")
    base, extra = list(range(1, n_base + 1)), list(range(n_base + 1, n_base + n_extra + 1))
    both = base + extra
    a1, b1 = train.fit(base)
    aj, bj = train.fit(both)
    # residuals have mean 0 and the target's covariances less the base's share
    cov_r = train.cov[extra, 0] - train.cov[np.ix_(extra, base)] @ b1
    inverse = np.linalg.pinv(train.cov[np.ix_(extra, extra)], hermitian=True)
    g = inverse @ cov_r
    sse1, ssej = train.error(base, a1, b1), train.error(both, aj, bj)
    sse2 = sse1 - train.n * float(g @ cov_r)
    free2, freej = train.n - n_extra - 1, train.n - n_base - n_extra - 1
    error = np.sqrt(np.maximum(np.diag(inverse), 0) * max(sse2, 0) / max(free2, 1) / train.n)
    a2 = a1 - float(train.mean[extra] @ g)
    full = np.concatenate([b1, g])
    out = {"coef": [(float(c), _ratio(float(c), float(s)), free2) for c, s in zip(g, error)], "segments": []}
    f = _ratio((sse1 - ssej) / n_extra, ssej / freej) if freej > 0 else float("nan")
    out["block"] = (f, n_extra, freej)
    for name, m in parts.items():
        around = m.total(train.mean[0])
        out["segments"].append((name, m.n, *(1 - _ratio(m.error(x, a, b), around) for x, a, b in ((base, a1, b1), (both, a2, full), (both, aj, bj))), f if name == "train" else None))
    r1, rj = 1 - _ratio(sse1, train.total()), 1 - _ratio(ssej, train.total())
    oos = [float("nan")] * 5
    if test:
        o1, oj = (1 - _ratio(test.error(x, a, b), test.total()) for x, a, b in ((base, a1, b1), (both, aj, bj)))
        oos = [o1, oj, oj - o1, test.corr(base, b1), test.corr(both, bj)]
    out["summary"] = [r1, rj, rj - r1, f, None, 1 - _ratio(sse2, sse1), *oos]
    return out


def _analysed(df: DataFrame, target: str, base: list[str], extra: list[str], rows, schema: str) -> DataFrame:
    """The rows that ``rows`` makes of the analysis of ``df`` by ``segment``; nothing without a train part."""
    found = moments(df, [target, *base, *extra], "segment").agg(F.collect_list(F.struct("segment", "n", "mean", "cov")).alias("parts"))  # a row a segment

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in batch.column(0).to_pylist():
                by = {p["segment"]: Moments(p) for p in sorted(parts, key=lambda p: p["segment"])}
                if "train" in by:
                    made = rows(analyse(by, len(base), len(extra)))
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in made], schema=arrow)

    fields = [f.split() for f in schema.split(", ")]
    names, kinds = [n for n, _ in fields], {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
    arrow = pa.schema([(n, kinds[t]) for n, t in fields])
    return found.mapInArrow(run, schema)


def two_stage_ols(df: DataFrame, target: str, base: list[str], extra: list[str]) -> DataFrame:
    """Base model, then its residuals on more columns, by ``segment``: R2 around the train mean, F of the block."""
    return _analysed(df, target, base, extra, lambda a: a["segments"], "segment string, n long, r2_base double, r2_two_stage double, r2_joint double, block_f double")


def ols_summary(df: DataFrame, target: str, base: list[str], extra: list[str]) -> DataFrame:
    """``metric, value``: R2 in and out of sample, F test of the added block with its probability, correlation of predictions."""
    rows = lambda a: [(k, n, v, *map(float, a["block"])) for k, (n, v) in enumerate(zip(SUMMARY, a["summary"]))]
    made = _analysed(df, target, base, extra, rows, "place long, metric string, value double, f double, above double, below double")
    p = fisher_p(F.col("f"), F.col("above"), F.col("below"))
    return made.select("place", "metric", F.when(F.col("metric") == "train_block_f_p", p).otherwise(F.col("value")).alias("value"))


def ols_coefficients(df: DataFrame, target: str, base: list[str], extra: list[str]) -> DataFrame:
    """``signal, coef, t, p`` of each added column in the model of the base's residuals."""
    rows = lambda a: [(s, c, t, float(n)) for s, (c, t, n) in zip(extra, a["coef"])]
    made = _analysed(df, target, base, extra, rows, "signal string, coef double, t double, free double")
    return made.select("signal", "coef", "t", F.when(F.isnan("t"), F.lit(None)).otherwise(student_p(F.col("t"), F.col("free"))).alias("p"))
