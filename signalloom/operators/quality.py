"""Gaps, coverage, cleaning, alignment and patching of series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.carried import lagged
from ..functions.whole import with_series


def _order(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("time_ms")


def any_value(columns: list[str]) -> Column:
    return F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull()


def all_values(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


def segments(df: DataFrame, keys: list[str], step_ms: int) -> DataFrame:
    """Runs of rows whose distance never exceeds the step."""
    fresh = (F.col("time_ms") - F.lag("time_ms").over(_order(keys)) > step_ms).cast("int")
    runs = df.withColumn("__new", F.coalesce(fresh, F.lit(0))).withColumn("segment", F.sum("__new").over(_order(keys)))
    return runs.groupBy(*keys, "segment").agg(F.min("time_ms").alias("start_ms"), F.max("time_ms").alias("end_ms"), F.count("*").alias("rows"))


def missing_points(df: DataFrame, keys: list[str], step_ms: int) -> DataFrame:
    """Every step that is absent between two rows."""
    ahead = df.select(*keys, "time_ms", F.lead("time_ms").over(_order(keys)).alias("__next")).where(F.col("__next") - F.col("time_ms") > step_ms)
    return ahead.select(*keys, F.explode(F.sequence(F.col("time_ms") + step_ms, F.col("__next") - 1, F.lit(step_ms))).alias("time_ms"))


def validation_report(df: DataFrame, keys: list[str], step_ms: int) -> DataFrame:
    """Counts, largest gap, coverage and status of each series."""
    gap = F.col("time_ms") - F.lag("time_ms").over(_order(keys))
    step = df.withColumn("__gap", gap)
    absent = F.greatest(F.floor(F.col("__gap") / step_ms) - 1, F.lit(0))
    out = step.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count("time_ms").alias("valid_rows"), (F.count("time_ms") - F.countDistinct("time_ms")).alias("duplicates"),
        F.sum(absent).cast("long").alias("missing"), F.max("__gap").alias("max_gap_ms"), F.min("time_ms").alias("start_ms"), F.max("time_ms").alias("end_ms"),
    )
    out = out.withColumn("missing", F.coalesce("missing", F.lit(0)).cast("long"))
    distinct = F.col("valid_rows") - F.col("duplicates")
    status = F.when(F.col("valid_rows") == 0, "FAIL").when((F.col("missing") > 0) | (F.col("duplicates") > 0), "WARN").otherwise("OK")
    return out.withColumn("coverage_pct", F.round(100 * distinct / (distinct + F.col("missing")), 4)).withColumn("status", status)


def gap_text(df: DataFrame, keys: list[str], step_ms: int, first: int = 20) -> DataFrame:
    """The first gaps of each series as text."""
    gaps = df.select(*keys, F.lag("time_ms").over(_order(keys)).alias("a"), F.col("time_ms").alias("b")).where(F.col("b") - F.col("a") > step_ms)
    at = Window.partitionBy(*keys).orderBy("a")
    gaps = gaps.withColumn("__r", F.row_number().over(at)).where(F.col("__r") <= first)
    return gaps.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "b"))), lambda g: F.concat(g["a"].cast("string"), F.lit("->"), g["b"].cast("string"))), ";").alias("gaps"))


def latest_segment(df: DataFrame, keys: list[str], max_gap_ms: int, width: int | None = None) -> DataFrame:
    """Rows after the last break.

    The last break of a series is one aggregate; with ``width`` the row before each row is
    found slice by slice of time, so no series, keyed or not, is one task.
    """
    if width:
        stepped = lagged(df, F.col("time_ms"), "__before", keys, "time_ms", width)
    else:
        stepped = df.withColumn("__before", F.lag("time_ms").over(_order(keys)))
    broke = F.col("time_ms") - F.col("__before") > max_gap_ms
    last = stepped.groupBy(*keys).agg(F.max(F.when(broke, F.col("time_ms"))).alias("__last"))
    return with_series(df, last, keys).where("__last is null or time_ms >= __last").drop("__last")


def clean_table(df: DataFrame, keys: list[str], values: list[str], max_gap_ms: int, width: int | None = None) -> DataFrame:
    """Rows with values, of the last segment, from its first complete row on, complete."""
    df = latest_segment(df.where(any_value(values)), keys, max_gap_ms, width)
    first = df.where(all_values(values)).groupBy(*keys).agg(F.min("time_ms").alias("__first"))
    return with_series(df, first, keys).where("time_ms >= __first").drop("__first").where(all_values(values))


def cleaned_tables(tables: dict[str, DataFrame], keys: list[str], values: list[str], max_gap_ms: int, width: int | None = None) -> DataFrame:
    """The aligned tables of several frequencies cleaned, one under the other with their ``freq``; one without complete rows leaves none."""
    parts = [df.select(F.lit(freq).alias("freq"), *df.columns) for freq, df in tables.items()]
    return clean_table(reduce(DataFrame.unionByName, parts), ["freq", *keys], values, max_gap_ms, width)


def align(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full outer alignment on time; columns are prefixed ``{table}__``.  One shuffle: union and group."""
    long = []
    values = {f"{t}__{c}": (t, c) for t, df in tables.items() for c in df.columns if c not in (*keys, "time_ms")}
    for t, df in tables.items():
        long.append(df.select(*keys, "time_ms", *(F.col(c) if owner == t else F.lit(None).cast(dict(tables[owner].dtypes)[c]) for c, owner in [(c, o) for o, c in values.values()])).toDF(*keys, "time_ms", *values))
    return reduce(DataFrame.union, long).groupBy(*keys, "time_ms").agg(*(F.max(v).alias(v) for v in values))


def patch_fill(df: DataFrame, patch: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Missing values from a patch table, and how many cells were filled in a row."""
    own = patch.select(*keys, "time_ms", *(F.col(v).alias(f"__p_{v}") for v in values))
    joined = df.join(own, [*keys, "time_ms"], "left")
    filled = reduce(lambda a, b: a + b, ((F.col(v).isNull() & F.col(f"__p_{v}").isNotNull()).cast("int") for v in values))
    return joined.withColumn("filled", filled).select(*[c for c in df.columns if c not in values], *(F.coalesce(v, f"__p_{v}").alias(v) for v in values), "filled")


def trimmed_ratio(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median ratio of two series on common times, without the outer percentiles."""
    both = a.select(*keys, "time_ms", F.col(value).alias("x")).join(b.select(*keys, "time_ms", F.col(value).alias("y")), [*keys, "time_ms"]).where("y <> 0")
    both = both.withColumn("ratio", F.col("x") / F.col("y"))
    w = Window.partitionBy(*keys)
    kept = both.withColumns({"lo": F.percentile("ratio", 0.01).over(w), "hi": F.percentile("ratio", 0.99).over(w)}).where("ratio between lo and hi")
    return kept.groupBy(*keys).agg(F.percentile("ratio", 0.5).alias("ratio"), F.count("*").alias("n"))


def calendar_fill(daily: DataFrame, keys: list[str], day: str, values: list[str]) -> DataFrame:
    """One row a day between the first and last of each key, absent days as zero."""
    span = daily.groupBy(*keys).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = span.select(*keys, F.explode(F.sequence("a", "b")).alias(day))
    return days.join(daily, [*keys, day], "left").select(*keys, day, *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def merge_check(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Coverage of ``left`` times by ``right`` and the share of equal values."""
    both = left.select(*keys, F.col(value).alias("x")).join(right.select(*keys, F.col(value).alias("y"), F.lit(1).alias("hit")), keys, "left")
    same = F.abs(F.col("x") - F.col("y")) <= tolerance * (1 + F.abs("y"))
    return both.agg(F.count("*").alias("rows"), F.count("hit").alias("covered"), F.avg(F.when(F.col("hit") == 1, same.cast("double"))).alias("match"))


def coverage_of_columns(df: DataFrame, keys: list[str], values: list[str], width: int | None = None) -> DataFrame:
    """Per column: non-null rows and the median positive step between them; by slices of time with ``width``."""
    long = df.unpivot([*keys, "time_ms"], values, "column", "value").where("value is not null")
    if width:
        long = lagged(long, F.col("time_ms"), "__before", [*keys, "column"], "time_ms", width)
    else:
        long = long.withColumn("__before", F.lag("time_ms").over(Window.partitionBy(*keys, "column").orderBy("time_ms")))
    return long.withColumn("step", F.col("time_ms") - F.col("__before")).groupBy(*keys, "column").agg(F.count("*").alias("rows"), F.percentile(F.when(F.col("step") > 0, F.col("step")), 0.5).alias("median_step"))
