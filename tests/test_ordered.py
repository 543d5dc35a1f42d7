"""Values carried across time cells against plain windows."""

import random

from pyspark.sql import Window, functions as F

from cuewright.operators.ordered import cell, neighbour, running


def rows(spark, seed):
    rnd = random.Random(seed)
    data = [(rnd.choice(["a", "b", None]), rnd.randrange(0, 60), i, rnd.choice([None, 1, 2, 3])) for i in range(120)]
    return spark.createDataFrame(data, "k string, t bigint, i int, v int").withColumn("_cell", cell(F.col("t"), 7))


def test_neighbour_equals_lag_and_lead(spark):
    df = rows(spark, 1)
    known = df.where('k IS NOT NULL')
    by = Window.partitionBy("k").orderBy("t", "i")
    want = {tuple(r) for r in known.select("k", "i", F.lag("v").over(by), F.lead("t").over(by)).collect()}
    got = neighbour(neighbour(df, ["k"], ["t", "i"], ["v"], "p_"), ["k"], ["t", "i"], ["t"], "n_", forward=True)
    assert {tuple(r) for r in got.select("k", "i", "p_v", "n_t").collect()} == want


def test_running_equals_windows(spark):
    df = rows(spark, 2)
    known = df.where('k IS NOT NULL')
    by = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)
    want = {tuple(r) for r in known.select("k", "i", F.coalesce(F.sum("v").over(by), F.lit(0)), F.max("v").over(by), F.last("v", ignorenulls=True).over(by)).collect()}
    got = running(df, ["k"], ["t", "i"], {"s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "v")})
    assert {tuple(r) for r in got.select("k", "i", "s", "m", "l").collect()} == want


def test_empty(spark):
    df = rows(spark, 3).where("false")
    assert neighbour(df, ["k"], ["t", "i"], ["v"], "p_").count() == 0
    assert running(df, ["k"], ["t", "i"], {"s": ("sum", "v")}).count() == 0
