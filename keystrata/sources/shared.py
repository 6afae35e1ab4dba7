"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only where it is unset (one machine, tests) a local folder stands in."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set(SETTING, root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes folders below the shared root that no result reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(p), True)
