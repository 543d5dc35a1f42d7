"""Documents as files, written from the executors."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Paths that would leave their folder.
LEAVES = r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|\z)"


def write_table(documents: DataFrame, folder: str, by: str | None = None) -> None:
    """Any number of documents as a Parquet table, replaced as a whole; Spark's commit makes it atomic."""
    writer = documents.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(folder)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """One file for each row of ``path, content`` under a folder that all executors share: ``path, bytes, error``.

    The folder must be a mount of all executors: files go through the file system, not Spark's. A file appears complete or
    not at all, under a name of the task's attempt before, so repeated and speculative tasks do no harm. Paths that leave the folder are refused with
    an error; of rows with one path the least content is written. Nothing happens before the result is read.
    """
    root = Path(folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            out = []
            for path, content, leaves in zip(b["path"].tolist(), b["content"].tolist(), b["leaves"].tolist()):
                if leaves:
                    out.append((path, 0, "leaves its folder"))
                    continue
                at = root / path
                at.parent.mkdir(parents=True, exist_ok=True)
                part = at.with_name(f".{at.name}.{attempt}.part")
                data = (content or "").encode()
                part.write_bytes(data)
                os.replace(part, at)
                out.append((path, len(data), None))
            yield pd.DataFrame(out, columns=["path", "bytes", "error"])

    one = files.where("path IS NOT NULL AND path <> ''").groupBy("path").agg(F.min("content").alias("content"))
    return one.select("path", "content", F.col("path").rlike(LEAVES).alias("leaves")).mapInPandas(write, "path string, bytes bigint, error string")


REFERENCE = "source_id string, language string, duration_ms bigint, claims array<struct<text:string,evidence:string,timestamp_ms:bigint,tolerance_ms:bigint>>"


def read_references(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark references, one JSON object a file: the well-formed ones, a claim a row, and the paths of the others."""
    rows = spark.read.schema(REFERENCE + ", _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("path", F.input_file_name())
    bad = F.col("_corrupt_record").isNotNull() | F.col("source_id").isNull()
    claims = rows.where(~bad).select("source_id", "language", "duration_ms", F.posexplode("claims").alias("claim_no", "c")).select("source_id", "language", "duration_ms", "claim_no", "c.*")
    return claims.withColumn("tolerance_ms", F.coalesce("tolerance_ms", F.lit(30_000))), rows.where(bad).select("path")
