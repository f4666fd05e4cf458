"""Exponential smoothing in one pass over ordered rows.

s_t = (1 - alpha) s_(t-1) + alpha x_t is a recursion over a whole series, which no window
frame of bounded size holds.  A numbering window brings the rows of a series together and
in order (without a shuffle of its own where they already are); Arrow batches of that
order are then folded by pandas' compiled recursion, and the last state of a batch goes
on into the next.  Memory is one batch, time is linear in the rows, and all smoothings
asked for together share the pass, so a plan grows by one node a nesting level.

A series may also be cut into slices of time (``width``).  A slice maps the state before it
to the state behind it: its first value joins that state with a weight that depends on the
rows since the last value, and what follows is an affine map of the result.  Slices are
summed up to these maps, the maps are composed in order (one row a slice), and each slice
is folded from its own start, so one series is spread over many tasks.
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

from .carried import SLICE, stored_slices


@dataclass(frozen=True)
class Smoothing:
    """``out`` is ``source`` smoothed by ``alpha``, NULL before ``least`` values.

    A NULL further on repeats the last state.  The weight of that state decays over it as
    over any row, or not at all where ``decay`` is off.
    """

    source: str
    out: str
    alpha: float
    least: int = 1
    decay: bool = True


class _State:
    """What one smoothing carries from batch to batch."""

    def __init__(self, spec: Smoothing):
        self.spec = spec
        self.reset()

    def reset(self) -> None:
        self.seen, self.last, self.empty = 0, float("nan"), 0  # values, last state, rows without one since

    def fold(self, x: np.ndarray, series: np.ndarray, goes_on: bool) -> np.ndarray:
        """Smoothed ``x``; ``series`` numbers its series, the first of which may go on from before."""
        if not goes_on:
            self.reset()
        before = np.concatenate([[self.last], np.full(self.empty, np.nan)]) if self.seen else np.zeros(0)
        values = pd.Series(np.concatenate([before, x]))
        number = np.concatenate([np.full(len(before), series[0]), series])
        smoothed = values.groupby(number).ewm(alpha=self.spec.alpha, adjust=False, ignore_na=not self.spec.decay).mean().to_numpy()[len(before) :]
        known = ~np.isnan(x)
        count = np.cumsum(known)
        first = np.searchsorted(series, series, "left")
        count = count - np.where(first > 0, count[first - 1], 0) + np.where(series == series[0], self.seen, 0)
        tail = np.flatnonzero(known & (series == series[-1]))
        alone = series[0] != series[-1]
        if len(tail):
            self.last, self.empty = float(smoothed[-1]), int(len(x) - 1 - tail[-1])
        elif alone:
            self.last, self.empty = float("nan"), 0
        else:
            self.empty += len(x)
        self.seen = int(count[-1])
        return np.where(count >= max(self.spec.least, 1), smoothed, np.nan)


def smooth(df: DataFrame, specs: list[Smoothing], keys: list[str], time: str, width: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``specs``; a column of the same name is replaced."""
    if not specs:
        return df
    if width:
        return _smooth_slices(df, specs, keys, time, width)
    made = [s.out for s in specs]
    kept = [c for c in df.columns if c not in made]
    order = Window.partitionBy(*keys).orderBy(time)
    inputs = [F.col(s.source).cast("double").alias(f"__x{k}") for k, s in enumerate(specs)]
    numbered = df.select(*kept, *inputs, F.row_number().over(order).alias("__row"))
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, T.DoubleType()) for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = [_State(s) for s in specs]
        for b in batches:
            if not b.num_rows:
                continue
            starts = np.array(b.column("__row")) == 1
            series = np.cumsum(starts)
            new = [s.fold(b.column(f"__x{k}").to_numpy(zero_copy_only=False).astype(float), series, not starts[0]) for k, s in enumerate(states)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(v, pa.float64(), from_pandas=True) for v in new)], [*kept, *made])

    return numbered.mapInArrow(run, schema)


def slice_map(spec: Smoothing, x: np.ndarray) -> dict[str, float]:
    """How a slice changes the state: its values, rows to the first and from the last, ``first``, and the end as ``gain`` times the state at the first value plus ``end``."""
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return {"seen": 0, "lead": len(x), "tail": len(x), "first": 0.0, "gain": 1.0, "end": 0.0}
    state = _State(spec)
    state.fold(x, np.zeros(len(x), np.int64), False)
    gaps = np.diff(at) if spec.decay else np.ones(len(at) - 1)
    w = (1 - spec.alpha) ** gaps
    gain = float(np.prod(w / (w + spec.alpha)))
    return {"seen": len(at), "lead": int(at[0]), "tail": int(len(x) - 1 - at[-1]), "first": float(x[at[0]]), "gain": gain, "end": state.last - gain * float(x[at[0]])}


def compose(spec: Smoothing, maps: list[dict]) -> list[tuple[int, float, int]]:
    """The state ``(values, last, rows since)`` before each slice of a series."""
    seen, last, empty, out = 0, float("nan"), 0, []
    for m in maps:
        out.append((seen, last, empty))
        if not m["seen"]:
            empty += m["tail"] if seen else 0
            continue
        if seen:
            w = (1 - spec.alpha) ** (empty + m["lead"] + 1 if spec.decay else 1)
            first = (w * last + spec.alpha * m["first"]) / (w + spec.alpha)
        else:
            first = m["first"]
        seen, last, empty = seen + m["seen"], m["gain"] * first + m["end"], m["tail"]
    return out


MAP = {"seen": T.LongType(), "lead": T.LongType(), "tail": T.LongType(), "first": T.DoubleType(), "gain": T.DoubleType(), "end": T.DoubleType()}
STATE = {"seen": T.LongType(), "last": T.DoubleType(), "empty": T.LongType()}


def _listed(rows: list[list[dict]], kind: dict[str, T.DataType]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.struct([(n, pa.int64() if isinstance(t, T.LongType) else pa.float64()) for n, t in kind.items()])))


def _smooth_slices(df: DataFrame, specs: list[Smoothing], keys: list[str], time: str, width: int) -> DataFrame:
    made = [s.out for s in specs]
    kept = [c for c in df.columns if c not in made]
    inputs = [F.col(s.source).cast("double").alias(f"__x{k}") for k, s in enumerate(specs)]
    cut = stored_slices(df.select(*kept, *inputs), time, width)
    by = [*keys, SLICE]
    lists = lambda kind: T.ArrayType(T.StructType([T.StructField(n, t) for n, t in kind.items()]))
    schema = lambda name, kind: T.StructType([*(cut.schema[c] for c in by), T.StructField(name, lists(kind))])
    values = lambda t, k: t.column(f"__x{k}").combine_chunks().to_numpy(zero_copy_only=False).astype(float)

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by(time)
        return table.slice(0, 1).select(by).append_column("maps", _listed([[slice_map(s, values(table, k)) for k, s in enumerate(specs)]], MAP))

    def composed(table: pa.Table) -> pa.Table:
        table = table.sort_by(SLICE)
        rows = table.column("maps").to_pylist()
        states = [compose(s, [r[k] for r in rows]) for k, s in enumerate(specs)]
        return table.select(by).append_column("states", _listed([[dict(zip(STATE, s[n])) for s in states] for n in range(len(rows))], STATE))

    def applied(table: pa.Table, before: pa.Table) -> pa.Table:
        table = table.sort_by(time)
        carried, series = before.column("states")[0].as_py(), np.zeros(table.num_rows, np.int64)
        new = []
        for k, s in enumerate(specs):
            state = _State(s)
            state.seen, state.last, state.empty = carried[k].values()
            new.append(pa.array(state.fold(values(table, k), series, True), pa.float64(), from_pandas=True))
        return pa.Table.from_arrays([*(table.column(c) for c in kept), *new], [*kept, *made])

    maps = cut.select(*by, time, *(f"__x{k}" for k in range(len(specs)))).groupBy(*by).applyInArrow(summed, schema("maps", MAP))
    states = maps.groupBy(*keys).applyInArrow(composed, schema("states", STATE))  # a row a slice
    out = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, T.DoubleType()) for c in made)])
    return cut.groupBy(*by).cogroup(states.groupBy(*by)).applyInArrow(applied, out)


def ewm(df: DataFrame, source: str, out: str, keys: list[str], time: str, alpha: float, least: int = 1, decay: bool = True, width: int | None = None) -> DataFrame:
    """``df`` with the smoothed ``source`` as ``out``."""
    return smooth(df, [Smoothing(source, out, alpha, least, decay)], keys, time, width)
