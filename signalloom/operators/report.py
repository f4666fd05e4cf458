"""Reports over tables and files: status, horizons, listings, daily figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def status_summary(report: DataFrame) -> DataFrame:
    """Files of each status of a validation report."""
    return report.groupBy("status").agg(F.count("*").alias("files"))


def horizons(df: DataFrame, keys: list[str], shortest: int = 5) -> DataFrame:
    """Days from the first to the last time of each series, the ``shortest`` ones."""
    span = df.groupBy(*keys).agg(F.min("time_ms").alias("start_ms"), F.max("time_ms").alias("end_ms"))
    return span.withColumn("days", (F.col("end_ms") - F.col("start_ms")) / 86_400_000).orderBy("days", *keys).limit(shortest)


def drop_redundant_times(df: DataFrame, suffixes: tuple[str, ...] = ("__time_utc", "__time", "__timestamp", "__date")) -> DataFrame:
    """Without the time columns that aligned tables bring along."""
    return df.drop(*(c for c in df.columns if c.endswith(suffixes)))


def feature_listing(spark: SparkSession, tables: dict[str, DataFrame], skipped: tuple[str, ...] = ("time_ms", "time_utc")) -> DataFrame:
    """``column`` and the frequencies whose table has it."""
    rows = [(f, c) for f, df in tables.items() for c in df.columns if c not in skipped]
    listed = spark.createDataFrame(rows, "frequency string, column string")
    return listed.groupBy("column").agg(F.array_join(F.sort_array(F.collect_set("frequency")), ",").alias("frequencies"))


def with_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Short names for the first of some long names that the table has."""
    found = {short: next((n for n in names if n in df.columns), None) for short, names in aliases.items()}
    return df.withColumns({short: F.col(f"`{name}`") for short, name in found.items() if name and short not in df.columns})


def as_float(df: DataFrame, exclude: tuple[str, ...] = ("time_ms", "time_utc")) -> DataFrame:
    """Numbers in single precision."""
    return df.withColumns({c: F.col(c).cast("float") for c, t in df.dtypes if c not in exclude and t.startswith(("double", "int", "bigint", "decimal", "smallint", "tinyint"))})


def most_active(df: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """The ``k`` rows with the largest figures among those above zero, back in time order."""
    return df.where(F.col(by[0]) > 0).orderBy(*(F.col(c).desc() for c in by), "time_ms").limit(k).orderBy("time_ms")


def worst_day(trace: DataFrame, keys: list[str], ret: str = "net_ret") -> DataFrame:
    """Net result a day, days without any known one as NULL, and the worst of each series (``place`` 1)."""
    daily = trace.groupBy(*keys, F.floor(F.col("time_ms") / 86_400_000).cast("long").alias("day")).agg(F.sum(ret).alias("net"))
    at = Window.partitionBy(*keys).orderBy(F.col("net").asc_nulls_last(), "day")
    return daily.withColumn("place", F.row_number().over(at))


def minute_merge(market: DataFrame, events: DataFrame, keys: list[str], columns: list[str], minute_ms: int = 60_000) -> DataFrame:
    """Market rows with the events of their minute, times in front; every market row stays."""
    own = events.select(*keys, F.col("time_ms").alias("whale_time_ms"), (F.floor(F.col("time_ms") / minute_ms) * minute_ms).alias("minute_ms"), *columns)
    out = market.withColumn("minute_ms", F.floor(F.col("time_ms") / minute_ms) * minute_ms).withColumnRenamed("time_ms", "price_time_ms").join(own, [*keys, "minute_ms"], "left")
    front = [*keys, "price_time_ms", "minute_ms", "whale_time_ms"]
    return out.select(*front, *(c for c in out.columns if c not in front))


def quick_report(df: DataFrame, columns: list[str], rows: int = 5_000) -> DataFrame:
    """Rows looked at, the first ``rows`` by time, and the values seen of some columns."""
    some = df.orderBy("time_ms", *columns).limit(rows)
    return some.agg(F.count("*").alias("rows"), *(F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ",").alias(c) for c in columns))


def value_map(column: str, values: dict, default):
    """A column of looked-up values."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def latest_folder(spark: SparkSession, root: str, names: list[str]) -> str | None:
    """The newest folder below ``root`` that holds all of some files; listed by the store's own file system."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [s for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    full = [s for s in folders if all(fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), n)) for n in names)]
    best = max(full, key=lambda s: (s.getModificationTime(), s.getPath().getName()), default=None)
    return best.getPath().toString() if best is not None else None
