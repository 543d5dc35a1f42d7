"""Continuous periods and gaps of a stream of intervals, kept in keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuewright.operators.intervals import GAPS, IntervalMap, _rows, _rows_in_cells, gap_rows
from cuewright.operators.ordered import CELL_MS
from cuewright.staging import shared_folder, staged_at


def _update(rows: Callable[[dict[tuple, IntervalMap]], pd.DataFrame], key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = IntervalMap(*state.get) if state.exists else IntervalMap()
    for b in batches:
        for s, e in zip(b["_start"].tolist(), b["_end"].tolist()):
            held.insert(s, e)
    state.update((held.starts, held.ends))
    yield rows({key: held})


def _stream(intervals: DataFrame, key: str, start: str, end: str, width: int, rows: Callable, columns: str) -> DataFrame:
    kept = _rows_in_cells(intervals, key, start, end, width).withColumn("_key", F.col("_key").cast("string"))
    return kept.groupBy("_key", "_cell").applyInPandasWithState(lambda k, b, s: _update(rows, k, b, s), f"_key string, _cell bigint, {columns}", "starts array<bigint>, ends array<bigint>", "update", GroupStateTimeout.NoTimeout)


def stream_periods(intervals: DataFrame, key: str, start: str, end: str, width: int = CELL_MS) -> DataFrame:
    """Per key and time cell its disjoint intervals after each batch that touches it: ``_key, _cell, _start, _end``.

    The state of a (key, cell) is an ordered interval map, which an insertion searches, merges and mends; a cell's length
    bounds it. Late rows are welcome, repeated ones change nothing. A cell's newest rows replace its former ones.
    """
    return _stream(intervals, key, start, end, width, _rows, "_start bigint, _end bigint")


def stream_gaps(intervals: DataFrame, key: str, start: str, end: str, width: int = CELL_MS) -> DataFrame:
    """The same for the gaps that a cell's map keeps: ``_key, _cell, _gap_start, _gap_end, _last``, to which ``joined_gaps`` applies."""
    return _stream(intervals, key, start, end, width, gap_rows, GAPS)


def newest(stream: DataFrame, name: str) -> DataFrame:
    """Run such a stream over what there is now, and return the newest rows of every (key, cell).

    Progress and state are kept in the shared folder, so a lost executor costs only its own tasks; a batch that is
    written again replaces itself.
    """
    spark = stream.sparkSession
    at = staged_at(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    run = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{shared_folder(spark)}/cuewright/{name}-progress-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, batch bigint").option("basePath", f"{at}/rows").parquet(f"{at}/rows")
    last = Window.partitionBy("_key", "_cell")
    return rows.withColumn("_last_batch", F.max("batch").over(last)).where("batch = _last_batch").drop("batch", "_last_batch")
