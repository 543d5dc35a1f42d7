"""Documents out of packs: digests, vault notes, JSON, and the cache of those already made."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuewright.functions.text import clock, provenance_label, safe_name
from cuewright.operators.ordered import join_one


def digests(topics: DataFrame, chapters: DataFrame) -> DataFrame:
    """A Markdown digest of each chapter: ``source_id, chapter_id, document``.

    ``topics`` from :func:`cuewright.operators.synthesis.topic_packs`, ``chapters`` with titles. A claim's line has its
    origin and, with evidence, its time. A long recording's digest comes in as many rows as it has chapters.
    """
    first = lambda c: F.try_element_at(c["evidence"], F.lit(1))["start_ms"]
    line = lambda c: F.concat(F.lit("- ["), provenance_label(c["provenance"]), F.lit("] "), c["text"], F.when(first(c).isNotNull(), F.concat(F.lit(" ("), clock(first(c)), F.lit(")"))).otherwise(F.lit("")))
    section = F.concat(F.lit("### "), F.col("topic_id"), F.lit("\n\n"), F.array_join(F.transform("claims", line), "\n"))
    per = topics.groupBy("source_id", "chapter_id").agg(F.sort_array(F.collect_list(F.struct("topic_id", section.alias("s")))).alias("t"))
    titled = per.join(chapters.select("source_id", "chapter_id", "title"), ["source_id", "chapter_id"], "left")
    heading = F.concat(F.lit("## "), F.coalesce(F.nullif(F.trim("title"), F.lit("")), "chapter_id"))
    return titled.select("source_id", "chapter_id", F.concat(heading, F.lit("\n\n"), F.array_join(F.transform("t", lambda x: x["s"]), "\n\n"), F.lit("\n")).alias("document"))


def named_notes(notes: DataFrame) -> DataFrame:
    """A file name for each note of a source (``source_id, topic_id, title``): adds ``name``; later notes of one title get their id added."""
    base = notes.withColumn("_name", safe_name(F.col("title")))
    first = base.groupBy("source_id", "_name").agg(F.min("topic_id").alias("_first"))  # combined before the shuffle, where a window would gather all notes of a title
    same = F.struct("source_id", "_name")
    keyed = base.withColumn("_key", F.to_json(same))
    both = join_one(keyed, first.select(F.to_json(same).alias("_key"), "_first"), "_key", "topic_id")
    own = F.concat("_name", F.lit("-"), safe_name(F.col("topic_id")))
    return both.withColumn("name", F.when(F.col("topic_id") == F.col("_first"), F.col("_name")).otherwise(own)).drop("_name", "_first", "_key")


def vault(notes: DataFrame, urls: DataFrame) -> DataFrame:
    """Files of a vault: ``source_id, path, content``, one a note. ``notes`` have ``source_id, topic_id, title, summary``, ``urls`` ``source_id, canonical_url``."""
    rows = join_one(named_notes(notes), urls.select("source_id", "canonical_url"), "source_id", "topic_id")
    head = F.concat(F.lit("---\nsource: "), F.coalesce("canonical_url", F.lit("")), F.lit("\ntopic_id: "), "topic_id", F.lit("\n---\n\n# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("summary", F.lit("")), F.lit("\n"))
    return rows.select("source_id", F.concat("name", F.lit(".md")).alias("path"), head.alias("content"))


def vault_index(notes: DataFrame) -> DataFrame:
    """The lines of each vault's index, one link a note, to be written in order of ``topic_id``: ``source_id, topic_id, line``."""
    return named_notes(notes).select("source_id", "topic_id", F.concat(F.lit("- [["), "name", F.lit("]]")).alias("line"))


def as_json(rows: DataFrame, key: str, pretty: bool = True) -> DataFrame:
    """Each row as one JSON document: ``key, document``."""
    return rows.select(key, F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("document"))


def cached(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requests (``cache_key``) into those with a made document (``cache_key, path, document``) and those without.

    Entries whose path is absolute or climbs out of its folder are never restored.
    """
    safe = cache.where(~F.col("path").rlike(r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|\z)"))
    return wanted.join(safe, "cache_key"), wanted.join(safe.select("cache_key").distinct(), "cache_key", "left_anti")
