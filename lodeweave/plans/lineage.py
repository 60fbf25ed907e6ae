"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lodeweave-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: losing an executor costs no earlier stage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodeweave_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system Hadoop knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame | None) -> None:
    """Delete the table behind a ``cut`` result that nothing reads any more."""
    path = getattr(df, "_lodeweave_path", None)
    if path:
        delete(df.sparkSession, path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean() -> None:
    """At the end of the driver nothing reads the tables written by it."""
    for spark, path in _WRITTEN:
        if path.startswith(("file:", "/")):
            shutil.rmtree(re.sub("^file:/+", "/", path), ignore_errors=True)
        else:
            try:
                delete(spark, path)
            except Exception:  # the session has ended: the folder's owner cleans up
                return
