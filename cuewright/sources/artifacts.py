"""A store of JSON objects under the hash of their content, as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "digest string, json string, size bigint"


def addressed(objects: DataFrame, column: str = "json") -> DataFrame:
    """Each distinct object once: ``digest, json, size`` in bytes. Nulls are no objects."""
    rows = objects.where(F.col(column).isNotNull()).select(F.sha2(F.col(column), 256).alias("digest"), F.col(column).alias("json"))
    return rows.groupBy("digest").agg(F.first("json").alias("json")).withColumn("size", F.octet_length("json").cast("bigint"))


def put(objects: DataFrame, folder: str, column: str = "json") -> None:
    """Add the objects that the store doesn't hold. Writing the same ones again adds nothing."""
    new = addressed(objects, column)
    held = get(objects.sparkSession, folder)
    if held is not None:
        new = new.join(held.select("digest"), "digest", "left_anti")
    new.withColumn("prefix", F.substring("digest", 1, 2)).write.mode("append").option("compression", "zstd").partitionBy("prefix").parquet(folder)


def get(spark: SparkSession, folder: str) -> DataFrame | None:
    """What the store holds, or None before the first write."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(SCHEMA + ", prefix string").parquet(folder).select("digest", "json", "size")


def checked(store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The objects whose content has its digest, and the digests of those that don't."""
    good = F.sha2("json", 256) == F.col("digest")
    return store.where(good), store.where(~F.coalesce(good, F.lit(False))).select("digest")


def usage(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def file_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Files and bytes under a folder, without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("bytes"))


def media_identity(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Local media under a folder: ``source_id, path``; the id comes from the bytes, so copies share it. A file is one row, so size bounds what this is for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1)).isin(*suffixes)
    return files.where(wanted).select(F.concat(F.lit("local:"), F.sha2("content", 256)).alias("source_id"), "path")
