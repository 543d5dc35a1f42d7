"""All queries of the core by name, with the SQL that computes the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuewright.plans import document_queries, interval_queries, pack_queries, queue_queries, relation_queries, transcript_queries

MODULES = (interval_queries, transcript_queries, relation_queries, queue_queries, document_queries, pack_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
