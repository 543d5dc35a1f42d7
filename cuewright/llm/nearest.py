"""Pairing rows of two tables by nearest time within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuewright.operators.ordered import cell, neighbour
from cuewright.staging import stage

#: Width of the index cells of the lowest level; each level doubles it.
BASE_MS = 16_384


def nearest_intervals(right: DataFrame, reach: int) -> DataFrame:
    """Turn ``_key, _at, _id`` into the times for which each row is the nearest: adds ``_lo, _hi``, both inclusive.

    The bounds are the midpoints to the neighbours in time, and ``reach`` at most. A time halfway between two rows
    belongs to the earlier. Of rows at one time the smallest ``_id`` stays.
    """
    one = right.groupBy("_key", "_at").agg(F.min("_id").alias("_id")).withColumn("_cell", cell(F.col("_at")))
    both = neighbour(one, ["_key"], ["_at"], ["_at"], "_before")
    both = neighbour(both, ["_key"], ["_at"], ["_at"], "_after", forward=True)
    lo = F.greatest(F.floor((F.col("_before_at") + F.col("_at")) / 2) + 1, F.col("_at") - reach)
    hi = F.least(F.floor((F.col("_after_at") + F.col("_at")) / 2), F.col("_at") + reach)
    return both.select("_key", "_at", "_id", lo.cast("bigint").alias("_lo"), hi.cast("bigint").alias("_hi"))


def nearest_in_time(
    left: DataFrame, right: DataFrame, key: str, left_id: str, left_at: str, right_id: str, right_at: str, tolerance: str | None = None, default_tolerance: int = 30_000
) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` of its ``key`` that is nearest in time and within the row's tolerance.

    Returns ``left_id, right_id, distance_ms``, one row per ``left_id`` with a match. Rows of either side without key or
    time match nothing; repeats of an id count once (the row smallest in key, time and tolerance); a null tolerance is
    ``default_tolerance`` and a negative one matches nothing. Of two rows equally near the earlier wins, of rows at one
    time the smaller id. Columns besides those named are ignored. Empty tables give no rows.

    The intervals of the right side are indexed in cells of their own size class, so each lies in two cells at most
    whatever its length; a time of the left side looks into its cell of each size class in use. The join is then an
    equality on (key, class, cell) with a range condition, and a hot key is spread over its cells.
    """
    tol = F.coalesce(F.col(tolerance).cast("bigint"), F.lit(default_tolerance)) if tolerance else F.lit(default_tolerance)
    ours = left.select(F.col(left_id).alias("_id"), F.col(key).alias("_key"), F.col(left_at).cast("bigint").alias("_t"), tol.cast("bigint").alias("_tol"))
    ours = ours.where("_id IS NOT NULL AND _key IS NOT NULL AND _t IS NOT NULL").groupBy("_id").agg(F.min(F.struct("_key", "_t", "_tol")).alias("r")).select("_id", "r.*")
    theirs = right.select(F.col(right_id).alias("_id"), F.col(key).alias("_key"), F.col(right_at).cast("bigint").alias("_at")).where("_id IS NOT NULL AND _key IS NOT NULL AND _at IS NOT NULL")
    reach = max(0, ours.agg(F.max("_tol")).first()[0] or 0)

    index = nearest_intervals(theirs, reach).withColumn("_class", F.greatest(F.lit(0), F.ceil(F.log2((F.col("_hi") - F.col("_lo") + 1) / BASE_MS))).cast("int"))
    index = stage(index, "nearest")
    classes = sorted(r[0] for r in index.select("_class").distinct().collect())  # 64 at most
    width = F.lit(BASE_MS) * F.pow(F.lit(2), F.col("_class"))
    at_cell = lambda c: F.floor(F.col(c) / width).cast("bigint")
    index = index.withColumn("_cell", F.explode(F.array_distinct(F.array(at_cell("_lo"), at_cell("_hi")))))
    probe = ours.withColumnRenamed("_id", "_left").withColumn("_class", F.explode(F.array(*[F.lit(c) for c in classes]).cast("array<int>"))).withColumn("_cell", at_cell("_t"))
    met = probe.join(index.withColumnRenamed("_id", "_right"), ["_key", "_class", "_cell"]).where("_t BETWEEN _lo AND _hi")
    found = met.withColumn("_distance", F.abs(F.col("_at") - F.col("_t"))).where("_distance <= _tol")
    return found.select(F.col("_left").alias(left_id), F.col("_right").alias(right_id), F.col("_distance").alias("distance_ms"))
