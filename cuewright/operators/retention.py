"""Which stored objects may go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuewright.functions.text import older_than

# Days after which temporary files, logs and unreferenced objects may go.
TEMPORARY_DAYS, LOG_DAYS, OBJECT_DAYS = 1, 30, 7


def expired_files(files: DataFrame, now: Column) -> DataFrame:
    """Of ``path, kind, modified_at, size`` the temporary files and logs past their age: ``path, reason, size``."""
    temporary = files.where((F.col("kind") == "temporary") & older_than(F.col("modified_at"), now, TEMPORARY_DAYS)).select("path", F.lit("expired_temporary_media").alias("reason"), "size")
    logs = files.where((F.col("kind") == "log") & older_than(F.col("modified_at"), now, LOG_DAYS)).select("path", F.lit("expired_log").alias("reason"), "size")
    return temporary.unionByName(logs)


def compact(objects: DataFrame, referenced: DataFrame, now: Column) -> DataFrame:
    """Objects (``digest, modified_at, size``) that nothing refers to and that are old enough: ``digest, reason, size``."""
    free = objects.join(referenced.select("digest"), "digest", "left_anti").where(older_than(F.col("modified_at"), now, OBJECT_DAYS))
    return free.select("digest", F.lit("unreachable_object").alias("reason"), "size")


def private(objects: DataFrame, referenced: DataFrame, exported: DataFrame) -> DataFrame:
    """Objects that only exported runs refer to (``referenced``: ``run_id, digest``; ``exported``: ``run_id``)."""
    others = referenced.join(exported.select("run_id").distinct(), "run_id", "left_anti").select("digest")
    mine = referenced.join(exported.select("run_id").distinct(), "run_id", "left_semi").select("digest").distinct().join(others, "digest", "left_anti")
    return objects.join(mine, "digest", "left_semi").select("digest", F.lit("private_after_export").alias("reason"), "size")


def plan(policy: str, objects: DataFrame, files: DataFrame, referenced: DataFrame, exported: DataFrame, now: Column) -> DataFrame:
    """What a policy (``compact``, ``private`` or ``archive``) removes: ``item, reason, size``. Nothing is deleted here."""
    due = expired_files(files, now).withColumnRenamed("path", "item")
    if policy == "archive":
        return due
    if policy == "compact":
        more = compact(objects, referenced, now)
    elif policy == "private":
        more = private(objects, referenced, exported)
    else:
        raise ValueError(f"unknown retention policy: {policy}")
    return due.unionByName(more.withColumnRenamed("digest", "item"))


def totals(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("removed"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("freed"))
