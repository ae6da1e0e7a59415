"""Folders for intermediate files that the driver and the executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, removed when the driver ends; below a folder of our own only where that is unset and Spark runs in this machine's JVM."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="vidra-scratch-"))
        found = _own[0]
    path = f"{found.rstrip('/')}/vidra/{uuid.uuid4().hex}-{name}"
    atexit.register(_remove, spark, path)
    return path


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of what is done, which else stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass
