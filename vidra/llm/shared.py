"""Shared-folder tables and other session helpers of the subpackage.

Intermediate results are written as Parquet below ``spark.checkpoint.dir``, the folder
that driver and executors share, so that a lost executor costs a re-read and not a
recomputation of the whole lineage.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id wherever rows are keyed by id.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a folder of our own only where it is unset and Spark runs in this machine's JVM."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if _own.get("dir") is None:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="vidra-shared-")
    return _own["dir"]


_own: dict[str, str | None] = {"dir": None}


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/vidra/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Kept:
    """A DataFrame written to the shared folder and read back; ``drop()`` deletes the files."""

    def __init__(self, spark: SparkSession, df: DataFrame, name: str):
        self.spark, self.path = spark, new_path(spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def keep(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return Kept(spark, df, name).df


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of queries that are done with: it waits for the driver's garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_only(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and ``more``) of a table that may have any other columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def count_upto(df: DataFrame, most: int) -> int:
    """Rows of ``df``, or ``most`` + 1 if there are more."""
    return df.limit(most + 1).count()


_shipped: dict[str, str] = {}
#: Bytes of an Arrow batch sent to Python; rows can be of any size, and a task holds a few copies of a batch.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Characters of a plan's description, which the driver keeps for every query that it ran.
PLAN_CHARS = 1 << 14
_PLAN = "spark.sql.maxPlanStringLength"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, wherever the driver imported it from; keep Arrow batches and plan descriptions small."""
    import os
    import zipfile

    now = spark.conf.get(_BATCH, "64m").strip().lower()
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if int(spark.conf.get(_PLAN).rstrip("bB")) > PLAN_CHARS:
        spark.conf.set(_PLAN, str(PLAN_CHARS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="vidra-code-"), "vidra.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join(os.path.basename(top), os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _shipped[app] = path
