"""Intermediate tables in the shared folder, used to cut lineage and to read a costly step twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset (tests, local runs) one is made and set."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cuewright-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Tables written by this process.
_STAGED: list[str] = []


def staged_at(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, removed by :func:`release` or when the JVM ends."""
    at = f"{shared_folder(spark)}/cuewright/{name}-{uuid.uuid4().hex}"
    _STAGED.append(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back.

    The files outlive executors, so a lost one costs only its own tasks. They are removed by :func:`release`, else when
    the JVM ends.
    """
    spark = df.sparkSession
    at = staged_at(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def release(spark: SparkSession) -> int:
    """Remove the tables staged so far, once the results that read them are written; returns their number."""
    n = len(_STAGED)
    while _STAGED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
