"""Terciles of a value over a whole series and over its growing history.

Both are exact and keep no series in one task: ranges of values and slices of time are the
units, dealt out by approximate cuts.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.carried import SLICE, in_slices, slice_width
from ..functions.whole import PARTS, with_series, cumulative, cut_points
from ..workspace import Workspace


def vol_regime(df: DataFrame, keys: list[str], value: str, time: str = "time_ms", parts: int = PARTS) -> DataFrame:
    """Whole-sample terciles by rank, first come first on ties, of the rows that have a value.

    The first (n - 1) / 3 and 2 (n - 1) / 3 rows, rounded up, end the lower two; the value
    and then the time of each such row are found by counting.
    """
    ws = Workspace(df.sparkSession, "terciles")
    known = df.where(F.col(value).isNotNull())
    counted = cumulative(ws, known, keys, value, parts)
    last = lambda k: F.ceil((F.col("size") - 1) * k / 3).cast("long")
    edge = lambda k: F.min(F.when((last(k) > 0) & (F.col("upto") >= last(k)), F.struct(F.col(value).alias("v"), (last(k) - F.col("upto") + F.col("n")).alias("need"))))
    edges = ws.save(counted.groupBy(*keys).agg(*(edge(k).alias(f"__e{k}") for k in (1, 2))))
    for k in (1, 2):  # among rows of the edge's value the earliest count
        tied = with_series(known, edges, keys).where(F.col(value) == F.col(f"__e{k}.v")).select(*keys, F.col(time).alias("__t"), F.col(f"__e{k}.need").alias("__need"))
        at = cumulative(ws, tied, [*keys, "__need"], "__t", parts)
        until = at.where(F.col("upto") >= F.col("__need")).groupBy(*keys).agg(F.min("__t").alias(f"__t{k}"))
        edges = ws.save(with_series(edges, until, keys))
    inside = lambda k: F.coalesce((F.col(value) < F.col(f"__e{k}.v")) | ((F.col(value) == F.col(f"__e{k}.v")) & (F.col(time) <= F.col(f"__t{k}"))), F.lit(False))
    return with_series(known, edges, keys).withColumn("regime", F.when(inside(1), 0).when(inside(2), 1).otherwise(2)).select(*df.columns, "regime")


def _at_most(below: int, upto: int, low: float, high: float, v: float, at: float) -> bool:
    """Whether ``v`` is at most the value at place ``at`` of a sorted history, by how many are below it and up to it and by its neighbours."""
    i = int(at)
    if below <= i:  # the value at i is v or more
        return True
    if below > i + 1:  # the value at i + 1 is less than v
        return False
    return low + ((v if upto > below else high) - low) * (at - i) >= v  # i is the last one below v


def expanding_regime(df: DataFrame, keys: list[str], value: str, least: int = 30, time: str = "time_ms", width: int | None = None, parts: int = PARTS) -> DataFrame:
    """Tercile of each value in the history before it; causal; NULL before ``least`` values and for missing ones.

    A value's place in its history is counted in two parts.  Earlier values of its own range
    are counted in a group of that range (a range that is one value, as a frequent one is,
    needs none).  Earlier values of other ranges are counted by slices of time: each slice
    starts with the number, least and greatest of every range so far.
    """
    ws, columns = Workspace(df.sparkSession, "expanding"), df.columns
    width = width or slice_width(df, keys, time)
    rows = in_slices(df.withColumn("__id", F.monotonically_increasing_id()), time, width).withColumn("__v", F.col(value).cast("double"))
    rows = with_series(rows, cut_points(df.withColumn("__v", F.col(value).cast("double")), keys, "__v", parts), keys)
    below, on = F.size(F.filter("__cuts", lambda c: c < F.col("__v"))), F.array_contains("__cuts", F.col("__v"))
    rows = ws.save(rows.withColumn("__b", F.when(F.col("__v").isNotNull() & F.col("__cuts").isNotNull(), 2 * below + on.cast("int"))).drop("__cuts"))  # odd: exactly a cut

    inner = T.StructType([T.StructField("__id", T.LongType()), T.StructField("__below", T.LongType()), T.StructField("__upto", T.LongType()), T.StructField("__low", T.DoubleType()), T.StructField("__high", T.DoubleType())])

    def ranked(table: pa.Table) -> pa.Table:
        table = table.sort_by([(time, "ascending"), ("__id", "ascending")])
        seen: list[float] = []
        out = []
        for i, v in zip(table.column("__id").to_pylist(), table.column("__v").to_pylist()):
            a, b = bisect.bisect_left(seen, v), bisect.bisect_right(seen, v)
            out.append((i, a, b, seen[a - 1] if a else None, seen[b] if b < len(seen) else None))
            seen.insert(b, v)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], inner.names)

    own = rows.where("__b % 2 = 0").select(*keys, "__b", "__id", "__v", time).groupBy(*keys, "__b").applyInArrow(ranked, inner)
    placed = rows.join(own, "__id", "left")

    totals = rows.where("__b is not null").groupBy(*keys, SLICE, "__b").agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    cells = totals.groupBy(*keys, SLICE).agg(F.collect_list(F.struct("__b", "n", "lo", "hi")).alias("cells"))  # at most 2 parts + 1 a slice
    size = 2 * parts + 1
    state = T.StructType([*(rows.schema[c] for c in [*keys, SLICE]), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("n", "lo", "hi"))])

    def before(table: pa.Table) -> pa.Table:
        """The state of all ranges before each slice."""
        table = table.sort_by(SLICE)
        n, lo, hi = np.zeros(size), np.full(size, np.inf), np.full(size, -np.inf)
        out: list[list] = [[], [], []]
        for cells in table.column("cells").to_pylist():
            for kept, now in zip(out, (n, lo, hi)):
                kept.append(now.tolist())
            for c in cells or ():
                n[c["__b"]] += c["n"]
                lo[c["__b"]], hi[c["__b"]] = min(lo[c["__b"]], c["lo"]), max(hi[c["__b"]], c["hi"])
        return pa.Table.from_arrays([*(table.column(c) for c in [*keys, SLICE]), *(pa.array(o, pa.list_(pa.float64())) for o in out)], state.names)

    slices = with_series(rows.select(*keys, SLICE).distinct(), cells, [*keys, SLICE])
    states = slices.groupBy(*keys).applyInArrow(before, state)
    out = T.StructType([*df.schema.fields, T.StructField("regime", T.IntegerType())])

    def judged(table: pa.Table, carried: pa.Table) -> pa.Table:
        table = table.sort_by([(time, "ascending"), ("__id", "ascending")])
        n, lo, hi = (np.array(carried.column(c)[0].as_py()) for c in ("n", "lo", "hi"))
        regime = []
        each = (table.column(c).to_pylist() for c in ("__v", "__b", "__below", "__upto", "__low", "__high"))
        for v, b, under, upto, low, high in zip(*each):
            total = int(n.sum())
            if v is None or b is None:
                regime.append(None)
                continue
            if b % 2:
                under, upto = 0, int(n[b])
            lower = int(n[:b].sum())
            if total < least:
                regime.append(None)
            else:
                less = np.flatnonzero(n[:b]) if low is None else ()
                more = np.flatnonzero(n[b + 1 :]) if high is None else ()
                low = low if low is not None else float(hi[less[-1]]) if len(less) else v
                high = high if high is not None else float(lo[b + 1 + more[0]]) if len(more) else v
                at = [(total - 1) * q for q in (1 / 3, 2 / 3)]
                inside = [_at_most(lower + under, lower + upto, low, high, v, a) for a in at]
                regime.append(0 if inside[0] else 1 if inside[1] else 2)
            n[b] += 1
            lo[b], hi[b] = min(lo[b], v), max(hi[b], v)
        return table.select(columns).append_column("regime", pa.array(regime, pa.int32()))

    return placed.groupBy(*keys, SLICE).cogroup(states.groupBy(*keys, SLICE)).applyInArrow(judged, out)
