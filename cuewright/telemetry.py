"""Spans of driver steps, as a table and a report."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

SPANS = "name string, start_s double, end_s double, status string, attributes map<string,string>"


class Trace:
    def __init__(self) -> None:
        self.rows: list[tuple] = []

    @contextmanager
    def span(self, name: str, **attributes: object) -> Iterator[None]:
        """Time a block; one that raises is kept with the status ``error``."""
        start, status = time.time(), "ok"
        try:
            yield
        except BaseException:
            status = "error"
            raise
        finally:
            self.rows.append((name, start, time.time(), status, {k: str(v) for k, v in attributes.items()}))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SPANS)


def summary(spans: DataFrame) -> DataFrame:
    """Per name: ``spans, errors, total_ms, longest_ms``."""
    ms = (F.col("end_s") - F.col("start_s")) * 1000
    return spans.groupBy("name").agg(F.count("*").alias("spans"), F.count_if(F.col("status") == "error").alias("errors"), F.sum(ms).alias("total_ms"), F.max(ms).alias("longest_ms"))


def elapsed_ms(spans: DataFrame) -> DataFrame:
    """Wall time from the first start to the last end."""
    return spans.agg(((F.max("end_s") - F.min("start_s")) * 1000).alias("elapsed_ms"))


def timeline(spans: DataFrame) -> DataFrame:
    """Spans with ``after_ms``, when each began after the first, and ``took_ms``."""
    first = spans.agg(F.min("start_s").alias("_first"))
    both = spans.join(F.broadcast(first))  # one row
    return both.select(*spans.columns, ((F.col("start_s") - F.col("_first")) * 1000).alias("after_ms"), ((F.col("end_s") - F.col("start_s")) * 1000).alias("took_ms"))


def report(spans: DataFrame) -> DataFrame:
    """A Markdown table of spans, a line a span, to be read in order of ``after_ms``: ``after_ms, line``."""
    line = F.format_string("| %s | %.1f | %.1f | %s |", "name", "after_ms", "took_ms", "status")
    return timeline(spans).select("after_ms", line.alias("line"))
