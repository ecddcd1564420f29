"""Scratch tables in the folder that the driver and all executors share.

Loops cut their lineage by writing a table and reading it again, so a lost executor costs a re-read and no more.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs in this process (tests) a local folder is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not (master := spark.sparkContext.master).startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="taskframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when this driver ends."""
    path = f"{shared_root(spark)}/taskframe/{name}-{uuid.uuid4().hex}"
    atexit.register(_quietly, remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _quietly(f, *args) -> None:
    try:
        f(*args)
    except Exception:  # the JVM may be gone when the driver ends
        pass


def kept(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """df written once to the shared folder and read again, and its path."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int, str]:
    """Like `kept`, with the number of rows, which the write itself counts."""
    seen = Observation()
    out, path = kept(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"], path


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
