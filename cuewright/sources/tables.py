"""The stored tables, and the rules for which of their rows are valid.

Every rule keeps extra columns and orders ties by all that distinguishes the rows, so the same rows win on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuewright.operators.ordered import salted, spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def streamed_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files; it may be one file or a folder of them."""
    reader = spark.readStream.schema(table(spark, folder, name).schema)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def latest(df: DataFrame, keys: list[str], at: str, keep: list[str]) -> DataFrame:
    """Of each key the row with the latest ``at``, reduced to ``keep``. Null keys are dropped.

    ``max`` over a struct combines before the shuffle, where a ranking window would move every row. Rows tied in ``at``
    are ordered by the kept columns; a null ``at`` comes first.
    """
    known = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    top = known.groupBy(*keys).agg(F.max(F.struct(at, *[c for c in keep if c != at])).alias("_top"))
    return top.select(*keys, *[F.col("_top").getField(c).alias(c) for c in keep])


def valid_transcripts(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per source: the one ingested last."""
    return latest(df, ["source_id"], "ingested_at", keep)


def valid_chapters(df: DataFrame) -> DataFrame:
    """One row per chapter of a source: the one received last."""
    return latest(df, ["source_id", "chapter_id"], "received_at", ["ord", "title", "start_ms", "end_ms"])


def counted_cues(segments: DataFrame, transcripts: DataFrame, keep: tuple[str, ...] = ("start_ms", "end_ms", "text", "speaker")) -> DataFrame:
    """Cues of known sources, each (``source_id``, ``seg_idx``) once: ``source_id, seg_idx`` and the columns to ``keep``.

    Deliveries of one cue differ in spacing or markup only; the least stays. Null keys are dropped. The salt follows from
    the index, so one shuffle by (source, salt) serves both steps and splits a long recording.
    """
    known = spread(transcripts.where("source_id IS NOT NULL").select("source_id").distinct())
    rows = salted(segments.where("source_id IS NOT NULL AND seg_idx IS NOT NULL"), "seg_idx").join(known, ["source_id", "_salt"], "left_semi")
    least = rows.groupBy("source_id", "_salt", "seg_idx").agg(F.min(F.struct(*keep)).alias("c"))
    return least.select("source_id", "seg_idx", "c.*")
