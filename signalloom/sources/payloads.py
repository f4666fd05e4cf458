"""Raw payloads, time coercion, keys and upserts."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEXT_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"]
STEP_MS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "1h": 3_600_000}


def jobs(endpoints: list[str], intervals: list[str] | None = None) -> list[tuple[str, str]]:
    """Endpoint and interval of every table to fetch."""
    return [*itertools.product(endpoints, intervals or STEP_MS)]


def job_of(name: str) -> tuple[str, str] | None:
    """Endpoint and interval from a file name ``{endpoint}_..._{interval}.csv``."""
    m = re.fullmatch(r"(.+?)_[^_]+_[^_]+_(1m|5m|15m|1h)\.\w+", name)
    return (m[1], m[2]) if m else None


def to_epoch_ms(value: Column) -> Column:
    """Seconds, milliseconds or text to epoch milliseconds; NULL for anything else."""
    number = value.try_cast("double")
    text = F.coalesce(*(F.try_to_timestamp(value, F.lit(f)) for f in TEXT_FORMATS))
    return F.when(number.isNotNull(), F.when(number < 1e10, number * 1000).otherwise(number).cast("long")).otherwise(F.unix_millis(text))


def infer_time(df: DataFrame, candidates: list[str]) -> Column:
    """The first candidate column that holds a usable time."""
    return F.coalesce(*(to_epoch_ms(F.col(c).cast("string")) for c in candidates if c in df.columns))


def parse_time_like(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` as epoch milliseconds, its unit decided once for the table.

    By the median of the numbers: above 1e12 milliseconds, above 1e9 seconds, else text.
    The median is one row, so its join is a broadcast.
    """
    number = F.col(column).try_cast("double")
    unit = df.agg(F.percentile_approx(number, 0.5, 10_000).alias("__median"))
    value = F.when(F.col("__median") > 1e12, number.cast("long")).when(F.col("__median") > 1e9, (number * 1000).cast("long"))
    text = F.unix_millis(F.coalesce(*(F.try_to_timestamp(F.col(column).cast("string"), F.lit(f)) for f in TEXT_FORMATS)))
    return df.crossJoin(F.broadcast(unit)).withColumn(column, F.coalesce(value, text)).drop("__median")


def prepared(df: DataFrame, times: list[str], keys: list[str]) -> DataFrame:
    """A loaded frame with parsed times, a ``time_ms`` from the first known one, sorted by it within its partitions."""
    for c in times:
        df = parse_time_like(df, c)
    df = df.withColumn("time_ms", F.coalesce(*times)).where("time_ms is not null")
    return df.repartition(*keys).sortWithinPartitions(*keys, "time_ms")


def explode_parallel(df: DataFrame, arrays: list[str]) -> DataFrame:
    """One row an element of parallel arrays; shorter ones are padded with NULL."""
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.explode(F.arrays_zip(*arrays)).alias("__z")).select(*rest, *(F.col(f"__z.{a}").alias(a) for a in arrays))


def success(code: Column) -> Column:
    return F.trim(code.cast("string")).isin("0", "0.0")


def row_key(df: DataFrame) -> Column:
    """The time, or a digest of the row where it has none."""
    return F.coalesce(F.col("time_ms").cast("string"), F.sha2(F.to_json(F.struct(*df.columns)), 256))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the new one where both have a key."""
    both = old.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, ["__src"]).drop("__src")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row a key, decided by ``order`` alone; no arbitrary pick."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def newer_than(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` past the stored maximum (one row, so the join is a broadcast)."""
    top = old.agg(F.max("time_ms").alias("__top"))
    return new.crossJoin(F.broadcast(top)).where("__top is null or time_ms > __top").drop("__top")


def load_series(spark: SparkSession, path: str, fmt: str = "parquet", keys: tuple[str, ...] = (), **options) -> DataFrame:
    """A table with a usable, unique ``time_ms`` a key; numbers are cast leniently."""
    df = spark.read.options(**options).format(fmt).load(path)
    df = df.withColumn("time_ms", F.col("time_ms").try_cast("long")).where("time_ms is not null")
    return keep_last(df, [*keys, "time_ms"], [c for c in df.columns if c != "time_ms"])


def read_partitions(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """A ``dt=``/``hh=`` table between two hours; the filter prunes partitions."""
    df = spark.read.parquet(path)
    hour = F.concat_ws(" ", F.col("dt").cast("string"), F.lpad(F.col("hh").cast("string"), 2, "0"))
    return df.where((F.col("dt") >= start[:10]) & (F.col("dt") <= end[:10]) & hour.between(start[:13], end[:13]))


def export(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write with ``time_ms`` first and the other columns sorted."""
    fmt = {"pq": "parquet", "parq": "parquet"}.get(fmt.lower(), fmt.lower())
    names = (["time_ms"] if "time_ms" in df.columns else []) + sorted(c for c in df.columns if c != "time_ms")
    writer = df.select(*names).write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))
