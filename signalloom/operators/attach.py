"""Event features on market bars: rolling features, attachment, resampling, cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeseries import Series


def minute_bundle(alerts: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """Alert and position features of each time that has either."""
    return alerts.join(positions, [*keys, "time_ms"], "full")


def rolling_features(df: DataFrame, columns: list[str], windows: list[int], keys: list[str]) -> DataFrame:
    """``{column}_mean_{w}`` and ``{column}_z_{w}`` (ddof 0) over full windows; a missing value is no event, so zero."""
    s, out = Series(keys, "time_ms"), {}
    for c in columns:
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        for w in windows:
            mean, sd = F.avg(x).over(s.last(w)), F.stddev_pop(x).over(s.last(w))
            out[f"{c}_mean_{w}"] = s.full(x, w, mean)
            out[f"{c}_z_{w}"] = s.full(x, w, F.when(sd > 0, (x - mean) / sd))
    return df.withColumns(out)


def attach(market: DataFrame, features: DataFrame, columns: list[str], keys: list[str], unit_ms: int = 60_000) -> DataFrame:
    """Features joined to the bar that holds their minute.

    The bar step is the median distance of the market's times in whole minutes, one at
    least; features of a longer step are summed over it.  The step is one row, so its
    join is a broadcast.
    """
    order = Window.partitionBy(*keys).orderBy("time_ms")
    gap = market.select((F.floor(F.col("time_ms") / unit_ms) - F.lag(F.floor(F.col("time_ms") / unit_ms)).over(order)).alias("gap"))
    step = gap.agg(F.greatest(F.lit(1), F.when(F.count("gap") >= 2, F.floor(F.percentile("gap", 0.5))).otherwise(1)).cast("long").alias("__step"))
    own = features.crossJoin(F.broadcast(step))  # step: one row
    own = own.withColumn("__at", F.floor(F.col("time_ms") / (unit_ms * F.col("__step"))) * unit_ms * F.col("__step"))
    summed = own.groupBy(*keys, "__at").agg(*(F.sum(c).alias(c) for c in columns))
    return market.withColumn("__at", F.floor(F.col("time_ms") / unit_ms) * unit_ms).join(summed, [*keys, "__at"], "left").drop("__at")


def risk_score(columns: list[str]) -> Column:
    """Mean of the columns that are known in a row."""
    known = reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns))
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    return F.when(known > 0, total / known)


def resample_events(df: DataFrame, columns: list[str], step_ms: int, keys: list[str], averaged: tuple[str, ...] = ("lev", "wavg")) -> DataFrame:
    """Right-closed, right-labelled sums; columns whose name says leverage or weighted average are averaged."""
    edge = (F.ceil(F.col("time_ms") / step_ms) * step_ms).alias("time_ms")
    return df.groupBy(*keys, edge).agg(*((F.avg if any(a in c for a in averaged) else F.sum)(c).alias(c) for c in columns))


def numeric_features(df: DataFrame, prefix: str = "whale_", extra: tuple[str, ...] = ()) -> list[str]:
    """Names of numeric columns with the prefix, and extra ones, sorted."""
    kinds = ("int", "bigint", "smallint", "tinyint", "float", "double", "decimal")
    return sorted(c for c, t in df.dtypes if c in extra or (c.startswith(prefix) and t.startswith(kinds)))


def exclude_families(df: DataFrame, prefixes: tuple[str, ...] = (), exact: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*(c for c in df.columns if c in exact or c.startswith(prefixes)))


def trim_window(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Rows from the first to the last that holds any of the columns."""
    has = F.when(F.coalesce(*(F.col(c).cast("double") for c in columns)).isNotNull(), F.col("time_ms"))
    w = Window.partitionBy(*keys)
    return df.withColumns({"__a": F.min(has).over(w), "__b": F.max(has).over(w)}).where("time_ms between __a and __b").drop("__a", "__b")


def fill_missing(df: DataFrame, columns: list[str], keys: list[str], policy: str = "zero") -> DataFrame:
    """``zero``: zero; ``ffill_then_zero``: the last known value, zero before the first."""
    if policy not in ("zero", "ffill_then_zero"):
        raise ValueError(policy)
    order = Window.partitionBy(*keys).orderBy("time_ms").rowsBetween(Window.unboundedPreceding, 0)
    known = lambda c: F.col(c).cast("double") if policy == "zero" else F.last(F.col(c).cast("double"), True).over(order)
    return df.withColumns({c: F.coalesce(known(c), F.lit(0.0)) for c in columns})


def null_gaps(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Runs of rows in which all of the columns are missing, the longest of a series first (``place`` 1)."""
    order = Window.partitionBy(*keys).orderBy("time_ms")
    empty = F.coalesce(*(F.col(c).cast("string") for c in columns)).isNull()
    runs = df.withColumn("__e", empty).withColumn("__g", F.sum((~F.col("__e")).cast("int")).over(order)).where("__e")
    gaps = runs.groupBy(*keys, "__g").agg(F.min("time_ms").alias("start_ms"), F.max("time_ms").alias("end_ms"), F.count("*").alias("rows"))
    longest = Window.partitionBy(*keys).orderBy(F.desc("rows"), "start_ms")
    return gaps.withColumn("place", F.row_number().over(longest)).drop("__g")


def starter_features(df: DataFrame, columns: list[str], keys: list[str], close: str = "close") -> DataFrame:
    """Returns over 1 and 5 bars, their 30-bar deviation and the share of missing cells in a row."""
    s = Series(keys, "time_ms")
    back = lambda n: F.try_divide(F.col(close), F.lag(close, n).over(s.order)) - 1
    df = df.withColumns({"feat_ret_1": back(1), "feat_ret_5": back(5)})
    missing = reduce(lambda a, b: a + b, (F.col(c).isNull().cast("int") for c in columns)) / len(columns)
    return df.withColumns({"feat_vol_30": s.full(F.col("feat_ret_1"), 30, F.stddev_samp("feat_ret_1").over(s.last(30))), "feat_missing_ratio": missing})


def feature_segments(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Runs of each column's known rows; a run ends where the step exceeds the column's median one."""
    by = [*keys, "column"]
    order = Window.partitionBy(*by).orderBy("time_ms")
    long = df.unpivot([*keys, "time_ms"], columns, "column", "value").where("value is not null")
    long = long.withColumn("__step", F.col("time_ms") - F.lag("time_ms").over(order))
    long = long.withColumn("__usual", F.percentile(F.when(F.col("__step") > 0, F.col("__step")), 0.5).over(Window.partitionBy(*by)))
    runs = long.withColumn("segment", F.sum(F.coalesce((F.col("__step") > F.col("__usual")).cast("int"), F.lit(0))).over(order))
    return runs.groupBy(*by, "segment").agg(F.min("time_ms").alias("start_ms"), F.max("time_ms").alias("end_ms"), F.count("*").alias("rows"))


def invalid_and_unsorted(df: DataFrame, raw: str, place: str, keys: list[str]) -> DataFrame:
    """Rows whose time is no number of digits, and those that stand behind a later time in file order (``place``)."""
    order = Window.partitionBy(*keys).orderBy(place)
    valid = F.col(raw).rlike("^[0-9]+$")
    time = F.when(valid, F.col(raw).try_cast("long"))
    df = df.withColumn("__t", time).withColumn("__late", F.col("__t") < F.last("__t", True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(F.col("__t").isNull()).alias("invalid"), F.count_if("__late").alias("unsorted"))


def profile(df: DataFrame, keys: list[str], time: str = "time_ms") -> DataFrame:
    """Rows, repeated keys and time range of a whole table, in one pass by key and one over its counts."""
    by = df.groupBy(*keys, time).agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"), F.min(time).alias("start_ms"), F.max(time).alias("end_ms"))


def around_shock(df: DataFrame, keys: list[str], ret: str, reach_ms: int) -> DataFrame:
    """Rows within ``reach_ms`` of each series' largest absolute return, the earliest on a tie."""
    w = Window.partitionBy(*keys)
    known = F.max_by(F.col("time_ms"), F.when(F.col(ret).isNotNull(), F.struct(F.abs(ret).alias("size"), (-F.col("time_ms")).alias("early")))).over(w)
    return df.withColumn("shock_ms", known).where(F.abs(F.col("time_ms") - F.col("shock_ms")) <= reach_ms)
