"""Running figures of a series that is cut into time slices, as an associative scan.

A running product, sum, maximum, last known value or run length depends on a whole past,
so a window over a series keeps that series in one task.  Here a slice of time of a series
is the unit: every slice is summed up by one small element (partial aggregation), the
elements of a series are composed in order (one row a slice), and each slice then runs
from what came before it.  A series of any length is spread over as many tasks as it has
slices, and no row travels but to its slice.

The elements compose associatively: sums by addition, products by multiplication, maxima
and last values by choice.  Run lengths are a number less the last number of a break.

The rows of a step are written once, for the elements and the figures both start from them:
figures that follow one another then cost a step each, not twice all that came before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace

SLICE = "__slice"


@dataclass(frozen=True)
class Carry:
    """``kind``: ``last`` (newest value that is not NULL), ``max``, ``sum`` or ``product`` of ``x``.

    A figure includes the row itself.  NULLs leave it as it is; before the first value it
    is NULL.
    """

    kind: str
    x: Column


def slice_width(df: DataFrame, keys: list[str], time: str, rows: int = 1_000_000) -> int:
    """A width of slices of about ``rows`` rows of the longest series, from one aggregate a series."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(time) - F.min(time)).alias("span")).agg(F.max(F.struct("n", "span")).alias("m")).first()["m"]
    if per is None or not per["span"] or per["n"] <= rows:
        return 2**62
    return max(1, int(per["span"] * rows // per["n"]))


def in_slices(df: DataFrame, time: str, width: int) -> DataFrame:
    return df.withColumn(SLICE, F.floor(F.col(time) / width))


def stored_slices(df: DataFrame, time: str, width: int) -> DataFrame:
    """``in_slices``, written and read again.

    Read from there, rows no longer lie together by series (as a window over series before
    leaves them), so the next step deals them by slices.
    """
    return Workspace(df.sparkSession, "slices").save(in_slices(df, time, width))


_AGGREGATE = {"max": F.max, "sum": F.sum, "product": F.product}


def carried(df: DataFrame, figures: dict[str, Carry], keys: list[str], time: str, width: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with a column for each of ``figures``, in the order of ``time`` and ``ties`` within ``keys``.

    What came before a slice joins it as its first row, so one window over slices gives the
    figures and the rows move once.
    """
    by, at = [*keys, SLICE], F.struct(time, *ties)
    inputs = {n: f"__x_{n}" for n in figures}
    columns = [c for c in df.columns if c not in figures]
    cut = stored_slices(df.withColumns({inputs[n]: c.x for n, c in figures.items()}), time, width)
    running = Window.partitionBy(*by).orderBy("__own", time, *ties).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    ends, before, out = [], [], {}
    for n, c in figures.items():
        x = F.col(inputs[n])
        if c.kind == "last":
            ends.append(F.max_by(x, F.when(x.isNotNull(), at)).alias(inputs[n]))
            before.append(F.last(inputs[n], True).over(past).alias(inputs[n]))
            out[n] = F.last(x, True).over(running)
        else:
            f = _AGGREGATE[c.kind]
            ends.append(f(x).alias(inputs[n]))
            before.append(f(inputs[n]).over(past).alias(inputs[n]))
            out[n] = f(x).over(running)
    states = cut.groupBy(*by).agg(*ends).select(*by, *before)  # a row a slice
    kinds = dict(states.dtypes)
    rows = cut.drop(*(c for c in figures if c in df.columns)).withColumns({x: F.col(x).cast(kinds[x]) for x in inputs.values()} | {"__own": F.lit(1)})
    both = rows.unionByName(states.withColumn("__own", F.lit(0)), allowMissingColumns=True)
    return both.withColumns(out).where("__own = 1").select(*columns, *figures)


def numbered(df: DataFrame, out: str, keys: list[str], time: str, width: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the number of each row in its series, from 1 on."""
    return carried(df, {out: Carry("sum", F.lit(1))}, keys, time, width, ties)


def run_lengths(df: DataFrame, holds: Column, out: str, keys: list[str], time: str, width: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with how many rows in a row up to each have met ``holds``: its number less that of the last row that did not."""
    df = numbered(df, "__at", keys, time, width, ties)
    df = carried(df, {"__broken": Carry("last", F.when(~F.coalesce(holds, F.lit(False)), F.col("__at")))}, keys, time, width, ties)
    return df.withColumn(out, F.col("__at") - F.coalesce("__broken", F.lit(0))).drop("__at", "__broken")


def lagged(df: DataFrame, x: Column, out: str, keys: list[str], time: str, width: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``x`` of the row before: the row before a slice's first is the last of the slices before."""
    by, at = [*keys, SLICE], F.struct(time, *ties)
    columns = [c for c in df.columns if c != out]
    cut = stored_slices(df.withColumn("__x", x), time, width)
    past = Window.partitionBy(*keys).orderBy(SLICE)
    ends = cut.groupBy(*by).agg(F.max_by("__x", at).alias("__x")).select(*by, F.lag("__x").over(past).alias("__x"))  # a row a slice
    both = cut.drop(*(c for c in [out] if c in df.columns)).withColumn("__own", F.lit(1)).unionByName(ends.withColumn("__own", F.lit(0)), allowMissingColumns=True)
    return both.withColumn(out, F.lag("__x").over(Window.partitionBy(*by).orderBy("__own", time, *ties))).where("__own = 1").select(*columns, out)
