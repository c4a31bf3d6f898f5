"""Folders for files that a query writes and reads back."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder of the session, or under a local one where none is set; removed when Python ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass
