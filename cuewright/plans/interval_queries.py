"""Queries over continuous periods and gaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuewright.operators import intervals
from cuewright.sources.tables import streamed_table, table, valid_transcripts
from cuewright.streaming import intervals as streams


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.uncovered(table(spark, folder, "segments"), valid_transcripts(table(spark, folder, "transcripts"), ["duration_ms"]))


def p4_periods(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.spoken_periods(table(spark, folder, "segments"), table(spark, folder, "transcripts"))


def p4_streamed(spark: SparkSession, folder: str) -> DataFrame:
    """The same gaps from a stream of the cues, whose maps are kept in keyed state."""
    cues = streamed_table(spark, folder, "segments")
    cells = streams.newest(streams.stream_gaps(cues, "source_id", "start_ms", "end_ms"), "gaps-stream")
    return intervals.up_to_durations(cells, valid_transcripts(table(spark, folder, "transcripts"), ["duration_ms"]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p4_periods": p4_periods, "p4_streamed": p4_streamed}

_COVER = """
    WITH tr AS (SELECT source_id, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ingested_at DESC, duration_ms DESC NULLS LAST) AS k FROM transcripts WHERE source_id IS NOT NULL) WHERE k = 1),
    c AS (SELECT s.source_id, start_ms, end_ms, max(end_ms) OVER (PARTITION BY s.source_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
          FROM segments s SEMI JOIN tr ON tr.source_id = s.source_id WHERE end_ms > start_ms)
"""
SQL: dict[str, str] = {
    "p4_found": _COVER
    + """
    SELECT source_id, greatest(coalesce(reach, 0), 0) AS gap_start_ms, start_ms AS gap_end_ms FROM c WHERE start_ms > greatest(coalesce(reach, 0), 0)
    UNION ALL
    SELECT tr.source_id, coalesce(m.e, 0), duration_ms FROM tr LEFT JOIN (SELECT source_id, max(end_ms) AS e FROM c GROUP BY 1) m USING (source_id) WHERE duration_ms > coalesce(m.e, 0)
    """,
    "p4_periods": _COVER
    + """
    , h AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM c)
    SELECT source_id, min(start_ms) AS period_start_ms, max(end_ms) AS period_end_ms FROM h GROUP BY source_id, g
    """,
}
SQL["p4_streamed"] = SQL["p4_found"]
