"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it again, so
a lost executor costs at most the stage that was running.  The setting is read from the
session; where it is unset, a temporary folder serves a local session, which is one
machine, and a session on a cluster gets an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}  # the temporary folder of each local application


class Workspace:
    """Named Parquet tables of one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not re.fullmatch(r"local(\[.*\])?", master):
                raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
            app = spark.sparkContext.applicationId
            base = _LOCAL.get(app) or "file://" + tempfile.mkdtemp(prefix="signalloom-")
            _LOCAL[app] = base
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        """``df`` written once and read back; the copy knows its own size."""
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def save_by(self, df: DataFrame, column: str, buckets: int) -> DataFrame:
        """``df`` written once in buckets of ``column``, so joins and groups by it move only the other side.

        Only a table of the catalog knows its buckets; its entry is dropped at once, the
        files and the frame that reads them stay.
        """
        self.count += 1
        name = f"bucketed_{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("path", f"{self.root}/t{self.count}").bucketBy(buckets, column).saveAsTable(name)
        out = self.spark.table(name)
        out.schema  # resolved before the entry goes
        self.spark.sql(f"DROP TABLE {name}")
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._workspace_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch, since documents may be very long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
