"""Rolling figures in time that hardly grows with the frame.

A window function reads every frame anew, and sorts it for a median.  Here the rows of a series come to Arrow batches
in order (as in ``smoothing``) and an indexed skip list follows the frame for medians,
quantiles and ranks (a row costs one insertion, one removal and one look-up), running sums
for moments.  A batch is preceded by the last rows of the batch
before it, as many as its frames reach back, so memory is a batch and a frame.  All figures
asked for together share the pass.

A long series is spread over tasks by ``chunk``: overlapping parts of so many rows, dealt by
row numbers that are themselves counted slice by slice where a ``width`` is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .carried import numbered


@dataclass(frozen=True)
class Rolling:
    """``out`` is a figure of the last ``n`` values of ``source``; NULL unless all ``n`` are there.

    ``kind``: ``quantile`` (linear between neighbours, at ``q``), ``rank`` (of the newest
    value, average on ties, over ``n``), or ``robust_z``: the distance to the median over
    1.4826 times the median distance, each row measured from the median of its own frame;
    ``mean, std, sum, min, max, zscore, skew, kurt`` as the window functions of those names,
    and with a second column ``corr, cov, beta``.
    """

    source: str
    out: str
    kind: str
    n: int
    q: float = 0.5
    other: str | None = None

    @property
    def reach(self) -> int:
        """Rows before the current one that matter."""
        return (self.n - 1) * (2 if self.kind == "robust_z" else 1)

    def of(self, x: np.ndarray, series: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
        """The figure of each row of ``x``; ``series`` numbers the series, which lie one after the other."""
        if self.kind in MOMENTS:
            return _rolled(x, series, self.n, MOMENTS[self.kind])
        if self.kind == "zscore":
            sd = _rolled(x, series, self.n, MOMENTS["std"])
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(sd != 0, (x - _rolled(x, series, self.n, MOMENTS["mean"])) / sd, np.nan)
        if self.kind == "kurt":
            flat = _rolled(x, series, self.n, MOMENTS["min"]) == _rolled(x, series, self.n, MOMENTS["max"])
            return np.where(flat, 0.0, _rolled(x, series, self.n, lambda r: r.kurt()))
        if y is not None:
            x, y = np.where(np.isnan(y), np.nan, x), np.where(np.isnan(x), np.nan, y)
            spread = [_rolled(v, series, self.n, MOMENTS["std"]) for v in (x, y)]
            cov = _paired(x, y, series, self.n)
            with np.errstate(divide="ignore", invalid="ignore"):
                if self.kind == "cov":
                    return cov
                if self.kind == "beta":
                    return np.where(spread[1] != 0, cov / spread[1] ** 2, np.nan)
                return np.where((spread[0] != 0) & (spread[1] != 0), np.clip(cov / (spread[0] * spread[1]), -1, 1), np.nan)
        if self.kind == "robust_z":
            median = _rolled(x, series, self.n, lambda r: r.median())
            far = np.abs(x - median)
            spread = _rolled(far, series, self.n, lambda r: r.median())
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(spread != 0, (x - median) / (1.4826 * spread), np.nan)
        if self.kind == "rank":
            return _rolled(x, series, self.n, lambda r: r.rank(method="average")) / self.n
        return _rolled(x, series, self.n, lambda r: r.quantile(self.q, interpolation="linear"))


MOMENTS = {k: (lambda r, k=k: getattr(r, k)()) for k in ("mean", "std", "sum", "min", "max", "skew")}
PAIRED = ("corr", "cov", "beta")


def _paired(x: np.ndarray, y: np.ndarray, series: np.ndarray, n: int) -> np.ndarray:
    """Rolling covariance (ddof 1) around each series' own mean, which keeps the digits."""
    edge = [0, *(np.flatnonzero(np.diff(series)) + 1).tolist(), len(x)]
    parts = []
    for a, b in zip(edge, edge[1:]):
        u, v = (pd.Series(w[a:b] - (np.nanmean(w[a:b]) if (~np.isnan(w[a:b])).any() else 0.0)) for w in (x, y))
        parts.append(u.rolling(n, min_periods=n).cov(v).to_numpy())
    return np.concatenate(parts) if len(x) else x


def _rolled(x: np.ndarray, series: np.ndarray, n: int, figure) -> np.ndarray:
    edge = [0, *(np.flatnonzero(np.diff(series)) + 1).tolist(), len(x)]
    return np.concatenate([figure(pd.Series(x[a:b]).rolling(n, min_periods=n)).to_numpy() for a, b in zip(edge, edge[1:])]) if len(x) else x


def overlapped(df: DataFrame, keys: list[str], lead: int, size: int, time: str = "time_ms", width: int | None = None) -> DataFrame:
    """``df`` with a ``__chunk`` of ``size`` rows of each series and, before it, ``lead`` rows of the chunk before (``__lead``).

    Functions of bounded frames give the same over chunks as over series, but a long
    series spreads over many tasks.  ``lead`` is at most ``size``.  With ``width`` the rows
    are numbered by slices of time, else by a window over each series.
    """
    if lead > size:
        raise ValueError(f"a chunk of {size} rows cannot lead another by {lead}")
    if width:
        df = numbered(df, "__n", keys, time, width).withColumn("__n", F.col("__n") - 1)
    else:
        df = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1)
    own, left = F.floor(F.col("__n") / size), size - F.col("__n") % size
    both = F.array(F.struct(own.alias("c"), F.lit(False).alias("l")), F.struct((own + 1).alias("c"), F.lit(True).alias("l")))
    dealt = df.withColumn("__v", F.explode(F.when(left <= lead, both).otherwise(F.slice(both, 1, 1))))
    return dealt.withColumns({"__chunk": F.col("__v.c"), "__lead": F.col("__v.l")}).drop("__v", "__n")


def roll(df: DataFrame, specs: list[Rolling], keys: list[str], time: str, chunk: int | None = None, width: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``specs``; a column of the same name is replaced."""
    if not specs:
        return df
    made = [s.out for s in specs]
    kept = [c for c in df.columns if c not in made]
    reach = max(s.reach for s in specs)
    sources = list(dict.fromkeys(c for s in specs for c in (s.source, s.other) if c))
    df = df.select(*kept, *(F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(sources)))
    by, out = list(keys), kept
    if chunk:
        df = overlapped(df, keys, reach, max(chunk, reach, 1), time, width)
        by, out = [*keys, "__chunk"], [*kept, "__lead"]
    numbers = df.select(*out, *(f"__x{k}" for k in range(len(sources))), F.row_number().over(Window.partitionBy(*by).orderBy(time)).alias("__row"))
    schema = T.StructType([*(numbers.schema[c] for c in out), *(T.StructField(c, T.DoubleType()) for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, behind = [np.zeros(0)] * len(sources), np.zeros(0, np.int64)  # the last rows, and their series
        for b in batches:
            if not b.num_rows:
                continue
            series = np.cumsum(np.array(b.column("__row")) == 1)
            number = np.concatenate([behind, series])
            x = [np.concatenate([p, b.column(f"__x{k}").to_numpy(zero_copy_only=False).astype(float)]) for k, p in enumerate(before)]
            new = [s.of(x[sources.index(s.source)], number, x[sources.index(s.other)] if s.other else None)[len(behind) :] for s in specs]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out), *(pa.array(v, pa.float64(), from_pandas=True) for v in new)], [*out, *made])
            keep = max(len(number) - reach, int(np.searchsorted(number, number[-1])))
            before, behind = [v[keep:] for v in x], np.zeros(len(number) - keep, np.int64)  # the next batch goes on as series 0, unless it starts anew

    rolled = numbers.mapInArrow(run, schema)
    return rolled.where("not __lead").drop("__lead") if chunk else rolled
