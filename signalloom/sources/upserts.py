"""Upserts into partitioned Parquet tables, in batch and from streams.

Only the partitions that new rows touch are read and replaced.  The merged rows are written
aside first; the replacement itself is Spark's dynamic overwrite, which moves whole
partitions when the job commits, so a reader sees each partition old or new.  A write that
is repeated, as after a crash between two moves or when a stream replays a batch, gives the
same table: the newest row of a key stays, whichever of two equal writes brought it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace
from .payloads import keep_last


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def upsert_table(new: DataFrame, path: str, keys: list[str], partition: str, order: list[str]) -> None:
    """Merge ``new`` into the table at ``path``: of the rows of a key the last by ``order`` stays, the new one on a tie.

    A key lives in one partition for good: ``partition`` is one of ``keys`` or follows from them.
    """
    ws = Workspace(new.sparkSession, "upsert")
    both = ws.save(new).withColumn("__new", F.lit(1))
    if exists(new.sparkSession, path):
        old = new.sparkSession.read.schema(new.schema).parquet(path)
        touched = both.select(partition).distinct()
        both = both.unionByName(old.join(touched, partition, "left_semi").withColumn("__new", F.lit(0)))  # prunes to the touched partitions
    merged = ws.save(keep_last(both, keys, [*order, "__new"]).drop("__new"))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upserting(path: str, keys: list[str], partition: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function; a replayed batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            upsert_table(batch, path, keys, partition, order)

    return write
