"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset a local session gets a
    temporary folder, removed at its end; on a cluster it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gridmeld.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="gridmeld-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("gridmeld.scratch.dir", root)
    return f"{root.rstrip('/')}/gridmeld-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: worked out once, and again only from there
    when an executor is lost. The folder stays, as later results may read it."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
