"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it again, so
a lost executor costs at most the stage that was running, and what several steps read is
computed once.  The setting is read from the session; where it is unset, a temporary
folder serves a local session, which is one machine, and a session on a cluster gets an
error.  No setting of the session is changed.
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
            master, app = spark.sparkContext.master, spark.sparkContext.applicationId
            if not re.fullmatch(r"local(\[.*\])?", master):
                raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
            base = _LOCAL.get(app) or "file://" + tempfile.mkdtemp(prefix="signalloom-")
            _LOCAL[app] = base
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        """``df`` written once and read back; the copy knows its own size."""
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
