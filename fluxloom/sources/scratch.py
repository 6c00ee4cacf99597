"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one; a temporary one where none is set and driver and
    executors are one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="spark-files-", dir="/tmp")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table: cuts the lineage of iterative plans."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
