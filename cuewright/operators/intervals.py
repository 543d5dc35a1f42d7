"""Continuous periods and gaps of overlapping time intervals per entity."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cuewright.operators.ordered import CELL_MS, cell, join_one, neighbour
from cuewright.staging import stage

#: Intervals that one task keeps before it passes its partial maps on.
HELD = 200_000


class IntervalMap:
    """Disjoint intervals in order, and the gaps between them. An insertion finds what it overlaps or touches by binary search, merges it and mends the gaps beside it."""

    __slots__ = ("starts", "ends", "gap_starts", "gap_ends")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts: list[int] = list(starts or ())
        self.ends: list[int] = list(ends or ())
        self.gap_starts, self.gap_ends = self.ends[:-1], self.starts[1:]

    def insert(self, start: int, end: int) -> int:
        """Add [start, end); the return value is by how much the number of intervals grew."""
        starts, ends = self.starts, self.ends
        if not starts or start > ends[-1]:  # in order, the usual case
            if starts:
                self.gap_starts.append(ends[-1])
                self.gap_ends.append(start)
            starts.append(start)
            ends.append(end)
            return 1
        i, j = bisect_left(ends, start), bisect_right(starts, end)
        if i < j:
            start, end = min(start, starts[i]), max(end, ends[j - 1])
        before, after = i > 0, j < len(starts)
        self.gap_starts[max(0, i - 1) : j] = [ends[i - 1]] * before + [end] * after
        self.gap_ends[max(0, i - 1) : j] = [start] * before + (starts[j : j + 1] if after else [])
        starts[i:j] = [start]
        ends[i:j] = [end]
        return 1 - (j - i)

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.gap_starts, self.gap_ends))


def _merge_any(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Before the shuffle: rows of a key lie anywhere, so the maps of all keys are held up to a bound."""
    held: dict[tuple, IntervalMap] = {}
    count = 0
    for batch in batches:
        for key, c, s, e in zip(batch["_key"], batch["_cell"], batch["_start"].tolist(), batch["_end"].tolist()):
            at = held.get((key, c))
            if at is None:
                at = held[key, c] = IntervalMap()
            count += at.insert(s, e)
        if count > HELD:
            yield _rows(held)
            held, count = {}, 0
    if held:
        yield _rows(held)


def _merge_sorted(batches: Iterator[pd.DataFrame], rows: Callable[[dict[tuple, IntervalMap]], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """After the shuffle: rows are sorted by key, so one map at a time is open. ``rows`` makes the result of finished ones."""
    now, at = None, IntervalMap()
    done: dict[tuple, IntervalMap] = {}
    for batch in batches:
        for key, c, s, e in zip(batch["_key"], batch["_cell"], batch["_start"].tolist(), batch["_end"].tolist()):
            if (key, c) != now:
                now, at = (key, c), IntervalMap()
                done[now] = at
            at.insert(s, e)
        if len(done) > 1:
            last = done.pop(now)
            yield rows(done)
            done = {now: last}
    if done:
        yield rows(done)


def _rows(maps: dict[tuple, IntervalMap]) -> pd.DataFrame:
    keys, cells, starts, ends = [], [], [], []
    for (key, c), m in maps.items():
        keys += [key] * len(m.starts)
        cells += [c] * len(m.starts)
        starts += m.starts
        ends += m.ends
    return pd.DataFrame({"_key": keys, "_cell": cells, "_start": starts, "_end": ends})


def gap_rows(maps: dict[tuple, IntervalMap]) -> pd.DataFrame:
    """The gaps of each map, and a row without a gap's start for the stretch before its first interval; with the map's last end."""
    out = []
    for (key, c), m in maps.items():
        out.append((key, c, None, m.starts[0], m.ends[-1]))
        out += [(key, c, s, e, m.ends[-1]) for s, e in m.gaps()]
    made = pd.DataFrame(out, columns=["_key", "_cell", "_gap_start", "_gap_end", "_last"])
    return made.astype({"_gap_start": "Int64"})


def _rows_in_cells(df: DataFrame, key: str, start: str, end: str, width: int) -> DataFrame:
    rows = df.select(F.col(key).alias("_key"), F.col(start).cast("bigint").alias("_start"), F.col(end).cast("bigint").alias("_end"))
    rows = rows.where("_key IS NOT NULL AND _start IS NOT NULL AND _end > _start")
    return rows.select("_key", cell(F.col("_start"), width).alias("_cell"), "_start", "_end")


def _merged(df: DataFrame, key: str, start: str, end: str, width: int, rows: Callable[[dict[tuple, IntervalMap]], pd.DataFrame], columns: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    partial = _rows_in_cells(df, key, start, end, width).mapInPandas(_merge_any, f"_key {kind}, _cell bigint, _start bigint, _end bigint")
    ordered = partial.repartition("_key", "_cell").sortWithinPartitions("_key", "_cell", "_start")
    return ordered.mapInPandas(lambda b: _merge_sorted(b, rows), f"_key {kind}, _cell bigint, {columns}")


def cell_periods(df: DataFrame, key: str, start: str, end: str, width: int = CELL_MS) -> DataFrame:
    """Per key and time cell (of the start) the disjoint intervals ``_start, _end``, as ``_key, _cell, _start, _end``.

    Rows with a null key, start or end, or an end not after the start, cover nothing. Each input partition merges what it
    holds before the shuffle, which then moves merged intervals only; a hot key is spread over its cells.
    """
    return _merged(df, key, start, end, width, _rows, "_start bigint, _end bigint")


GAPS = "_gap_start bigint, _gap_end bigint, _last bigint"


def cell_gaps(df: DataFrame, key: str, start: str, end: str, width: int = CELL_MS) -> DataFrame:
    """Per key and time cell what its interval map keeps of gaps (:func:`gap_rows`): ``_key, _cell, _gap_start, _gap_end, _last``."""
    return _merged(df, key, start, end, width, gap_rows, GAPS)


def _with_reach(periods: DataFrame) -> DataFrame:
    """Add ``_reach``: up to where anything that starts before this interval covers (null for the first of a key)."""
    along = Window.partitionBy("_key").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    near = Window.partitionBy("_key", "_cell").orderBy("_start")
    carried = periods.groupBy("_key", "_cell").agg(F.max("_end").alias("_in")).withColumn("_in", F.max("_in").over(along))
    return periods.withColumn("_before", F.lag("_end").over(near)).join(carried, ["_key", "_cell"]).select("_key", "_cell", "_start", "_end", F.greatest("_before", "_in").alias("_reach"))


def joined_gaps(cells: DataFrame, floor: int = 0) -> DataFrame:
    """The gaps of all cells of a key as one list, from ``floor`` to its last end: ``_key, gap_start_ms, gap_end_ms``.

    What earlier cells cover of a cell shortens its gaps; it comes from one row a cell.
    """
    along = Window.partitionBy("_key").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    edges = cells.where("_gap_start IS NULL").select("_key", "_cell", F.max("_last").over(along).alias("_reach"))
    begin = F.greatest("_gap_start", "_reach", F.lit(floor))  # greatest skips nulls
    return cells.join(edges, ["_key", "_cell"]).select("_key", begin.alias("gap_start_ms"), F.col("_gap_end").alias("gap_end_ms")).where("gap_end_ms > gap_start_ms")


def merged_periods(periods: DataFrame) -> DataFrame:
    """The continuous periods per key across cells: ``_key, period_start_ms, period_end_ms``. Touching intervals are one period."""
    heads = _with_reach(periods).where("_reach IS NULL OR _start > _reach")
    # a period ends where the cover before the next head ends, the last one where the key ends
    heads = neighbour(heads, ["_key"], ["_start"], ["_reach"], "_next", forward=True)
    last = periods.groupBy("_key").agg(F.max("_end").alias("_last"))
    return join_one(heads, last, "_key", "_start", "inner").select("_key", F.col("_start").alias("period_start_ms"), F.coalesce("_next_reach", "_last").alias("period_end_ms"))


def uncovered(segments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Gaps per source from 0 to its duration: ``source_id, gap_start_ms, gap_end_ms``.

    ``transcripts`` has one row per source; only its sources count. A duration that is null or before the last covered
    end adds nothing after that end; a source without any cover is one gap up to a known positive duration. Repeated
    cues change nothing. Empty tables give no rows.
    """
    return up_to_durations(stage(cell_gaps(segments, "source_id", "start_ms", "end_ms"), "gaps"), transcripts)


def up_to_durations(cells: DataFrame, transcripts: DataFrame) -> DataFrame:
    """:func:`uncovered` of cells' gaps that are already made."""
    last = cells.where("_gap_start IS NULL").groupBy(F.col("_key").alias("source_id")).agg(F.max("_last").alias("_last"))
    known = transcripts.where("source_id IS NOT NULL").select("source_id", F.col("duration_ms").cast("bigint").alias("_duration"))
    inner = join_one(joined_gaps(cells).withColumnRenamed("_key", "source_id"), known.select("source_id"), "source_id", "gap_start_ms", "left_semi")
    tail = known.join(last, "source_id", "left").select("source_id", F.coalesce("_last", F.lit(0)).alias("gap_start_ms"), F.col("_duration").alias("gap_end_ms"))
    return inner.unionByName(tail.where("gap_end_ms > gap_start_ms"))


def spoken_periods(segments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Continuous spoken periods per known source: ``source_id, period_start_ms, period_end_ms``."""
    known = transcripts.where("source_id IS NOT NULL").select("source_id").distinct()
    found = merged_periods(stage(cell_periods(segments, "source_id", "start_ms", "end_ms"), "periods"))
    return join_one(found.withColumnRenamed("_key", "source_id"), known, "source_id", "period_start_ms", "left_semi")
