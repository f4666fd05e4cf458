"""Ranks, order statistics and scaling over whole series without a window over a series.

Values of a series are counted first, so ties of any number are one row.  The distinct
values are cut into ranges at approximate quantiles (a mergeable sketch, a few numbers a
series), added up inside each range, and the ranges' totals are added up in order: every
value then knows exactly how many rows have it or a smaller one.  Approximate cuts only
deal out the work.  No task sees a whole series, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace

PARTS = 64


def with_series(df: DataFrame, figures: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the figures of its series (one row each); a NULL key is a series too."""
    if not keys:
        return df.crossJoin(F.broadcast(figures))  # one row
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return df.alias("l").join(figures.alias("r"), same, "left").select("l.*", *(f"r.{c}" for c in figures.columns if c not in keys))


def cut_points(df: DataFrame, keys: list[str], value: str, parts: int = PARTS) -> DataFrame:
    """``keys, __cuts``: values of each series that part it into about equal ranges."""
    return df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, [k / parts for k in range(1, parts)] or [1.0], 10_000)).alias("__cuts"))


def cumulative(ws: Workspace, df: DataFrame, keys: list[str], value: str, parts: int = PARTS) -> DataFrame:
    """``keys, value, n, upto, size``: how often each value occurs in its series, and how many rows have it or a smaller one."""
    counts = ws.save(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")))
    placed = with_series(counts, cut_points(counts, keys, value, parts), keys)
    placed = ws.save(placed.withColumn("__b", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts"))
    inside = placed.withColumn("__in", F.sum("n").over(Window.partitionBy(*keys, "__b").orderBy(value)))
    total = placed.groupBy(*keys, "__b").agg(F.sum("n").alias("__all"))  # at most ``parts`` rows a series
    order = Window.partitionBy(*keys).orderBy("__b")
    before = total.select(*keys, "__b", (F.sum("__all").over(order) - F.col("__all")).alias("__before"), F.sum("__all").over(Window.partitionBy(*keys)).alias("size"))
    return with_series(inside, before, [*keys, "__b"]).select(*keys, value, "n", (F.col("__in") + F.col("__before")).alias("upto"), "size")


def interpolated(share: float, value: str) -> Column:
    """Aggregate over ``cumulative``: the value at a share of the series, linear between neighbours."""
    at = (F.col("size") - 1) * F.lit(share)
    low, high = F.min(F.when(F.col("upto") > F.floor(at), F.col(value))), F.min(F.when(F.col("upto") > F.ceil(at), F.col(value)))
    part = F.max(at - F.floor(at))
    return low + (high - low) * part


@dataclass(frozen=True)
class Whole:
    """``out`` from the whole series of ``source``: its ``rank`` (share, average on ties), ``scale`` to a sum of sizes, or ``winsorize`` between two shares."""

    source: str
    out: str
    kind: str
    args: tuple[float, ...] = ()


def over_series(df: DataFrame, specs: list[Whole], keys: list[str], parts: int = PARTS) -> DataFrame:
    """``df`` with a column for each of ``specs``; a column of the same name is replaced."""
    for s in specs:
        ws, x = Workspace(df.sparkSession, "whole"), F.col("__x")
        columns = [c for c in df.columns if c != s.out]
        df = df.select(*columns, F.col(s.source).alias("__x"))
        if s.kind == "scale":
            a = s.args[0] if s.args else 1.0
            total = df.groupBy(*keys).agg(F.sum(F.abs(x)).alias("__t"))
            df = with_series(df, total, keys).withColumn(s.out, F.when(F.col("__t") != 0, a * x / F.col("__t")))
        elif s.kind == "rank":
            known = cumulative(ws, df.select(*keys, "__x"), keys, "__x", parts)
            share = known.select(*keys, "__x", ((F.col("upto") - (F.col("n") - 1) / 2) / F.col("size")).alias("__s"))
            df = with_series(df, share, [*keys, "__x"]).withColumn(s.out, F.col("__s"))
        elif s.kind == "winsorize":
            low, high = s.args or (0.01, 0.99)
            known = cumulative(ws, df.select(*keys, "__x"), keys, "__x", parts)
            bounds = known.groupBy(*keys).agg(interpolated(low, "__x").alias("__lo"), interpolated(high, "__x").alias("__hi"))
            df = with_series(df, bounds, keys).withColumn(s.out, F.when(x < F.col("__lo"), F.col("__lo")).when(x > F.col("__hi"), F.col("__hi")).otherwise(x))
        else:
            raise ValueError(f"no figure {s.kind}")
        df = df.select(*columns, s.out)
    return df
