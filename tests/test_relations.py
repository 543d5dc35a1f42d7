import random

from pyspark.sql import functions as F

from cuewright.operators import graph, retention
from cuewright.streaming.sessions import sessions


def test_readiness_and_blocking(spark):
    jobs = spark.createDataFrame([("t", "r", "completed", 20), ("c", "r", "pending", 10), ("p", "r", "pending", 5), ("f", "r", "failed_runtime", 20), ("x", "r", "pending", 10), ("y", "r", "pending", 5), ("z", "r", "pending", 1)], "job_id string, run_id string, status string, priority int")
    edges = spark.createDataFrame([("c", "t"), ("p", "c"), ("x", "f"), ("y", "x"), ("y", "x"), ("x", "y"), ("p", None)], "job_id string, depends_on string")
    assert [r.job_id for r in graph.ready(jobs, edges.where("depends_on IS NOT NULL"), 5).collect()] == ["z", "c"]
    assert {r.job_id for r in graph.blocked(jobs, edges).collect()} == {"x", "y"}
    assert graph.blocked(jobs.where("false"), edges).count() == 0
    runs = spark.createDataFrame([("r",), ("empty",)], "run_id string")
    assert {tuple(r) for r in graph.progress(runs, jobs).collect()} == {("r", 1, 7), ("empty", 0, 0)}


def test_limit_equals_the_step_by_step_fold(spark):
    rnd = random.Random(3)
    data = [(rnd.choice("ab"), rnd.randrange(0, 4 * 86_400), i, rnd.random() < 0.93) for i in range(600)] + [(None, 1, 1, True), ("a", None, 1, False), ("a", 1, 1, None)]
    events = spark.createDataFrame(data, "k string, s bigint, i int, ok boolean").withColumn("at", F.timestamp_seconds("s"))
    got = {r.k: (r.current_limit, r.success_streak) for r in graph.limit_after(events, "k", "at", "i", "ok", 8).collect()}
    for k in "ab":
        limit, streak = 8, 0
        for _, _, ok in sorted((s, i, ok) for key, s, i, ok in data if key == k and s is not None and ok is not None):
            if not ok:
                limit, streak = max(1, limit // 2), 0
            else:
                streak += 1
                if streak == 10:
                    limit, streak = min(8, limit + 1), 0
        assert got[k] == (limit, streak)


def test_changes(spark):
    schema = "k string, at int, v string"
    old, new = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old"), ("c", 2, "old")], schema), spark.createDataFrame([("a", 2, "new"), ("b", 4, "new"), ("c", 2, "new"), ("d", 1, "y"), ("d", 1, "x")], schema)
    assert {tuple(r) for r in graph.upserted(old, new, ["k"], "at").collect()} == {("a", 2, "new"), ("b", 5, "old"), ("c", 2, "new"), ("d", 1, "y")}
    assert {tuple(r) for r in graph.inserted(old, new, ["k"]).collect()} == {("a", 1, "old"), ("b", 5, "old"), ("c", 2, "old"), ("d", 1, "x")}
    rows = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), (None, "a")], "v string, r string")
    assert [r.v for r in graph.exclusive(rows, "v", spark.createDataFrame([("a",)], "r string"), "r").collect()] == ["y"]


def test_aggregates(spark):
    rows = spark.createDataFrame([("c", "m", 0.2), ("c", "m", 0.4), ("c", "m", 0.6), ("c", "n", 0.7), ("c", "n", None)], "c string, m string, v double")
    got = {r.m: (r.repeats, r.median, round(r.variance, 9)) for r in graph.repeat_statistics(rows, ["c"], "m", "v").collect()}
    assert got == {"m": (3, 0.4, 0.04), "n": (1, 0.7, 0.0)}
    usage = spark.createDataFrame([("a", {"x": 1, "y": 2}), ("a", {"y": 5}), ("b", None)], "k string, u map<string,bigint>")
    assert [tuple(r) for r in graph.map_sums(usage, "k", "u").collect()] == [("a", {"x": 1, "y": 7})]


def test_retention(spark):
    now = F.to_timestamp(F.lit("2026-08-16T00:00:00Z"))
    age = lambda df: df.withColumn("modified_at", now - F.make_interval(hours=F.col("h"))).drop("h")
    objects = age(spark.createDataFrame([("old", 8 * 24, 1), ("held", 10 * 24, 2), ("young", 24, 4)], "digest string, h int, size int"))
    files = age(spark.createDataFrame([("t1", "temporary", 25, 8), ("t2", "temporary", 23, 8), ("l1", "log", 31 * 24, 16), ("l2", "log", 29 * 24, 16)], "path string, kind string, h int, size int"))
    refs = spark.createDataFrame([("r1", "held"), ("r2", "old"), ("r2", "held")], "run_id string, digest string")
    done = spark.createDataFrame([("r2",)], "run_id string")
    items = lambda p, r: {x.item for x in retention.plan(p, objects, files, r, done, now).collect()}
    assert items("compact", refs.where("digest = 'held'")) == {"old", "t1", "l1"}
    assert items("private", refs) == {"old", "t1", "l1"} and items("archive", refs) == {"t1", "l1"}
    assert tuple(retention.totals(retention.plan("compact", objects, files, refs.where("false"), done, now)).first()) == (4, 27)


def test_sessions(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 60), ("a", 4000), ("b", 5), (None, 1), ("b", None)], "k string, s bigint").withColumn("at", F.timestamp_seconds("s"))
    got = {(r.k, r.s, r.events) for r in sessions(rows, "k", "at", "10 minutes").select("k", F.unix_seconds("session_start").alias("s"), "events").collect()}
    assert got == {("a", 0, 2), ("a", 4000, 1), ("b", 5, 1)}


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [("a", 0), ("a", 60), ("b", 5), ("a", 9000), ("z", 90_000)]
    spark.createDataFrame(rows, "k string, s bigint").withColumn("at", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, s bigint, at timestamp").parquet(str(tmp_path / "in"))
    query = sessions(stream, "k", "at", "10 minutes", "1 hour").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.k, r.events) for r in spark.table("closed").collect()} == {("a", 2), ("b", 1), ("a", 1)}


def test_job_graph_reuse_leases_and_removal(spark):
    topics = spark.createDataFrame([("s", "c1", "t1"), ("s", "c1", "t2"), ("s", "c2", "t3"), ("s", "c1", "t1"), (None, "c", "t")], "source_id string, chapter_id string, topic_id string")
    jobs, edges = graph.analysis_graph(topics)
    assert {(r.kind, r["count"]) for r in jobs.groupBy("kind").count().collect()} == {("topic", 3), ("chapter", 2), ("compose", 1)} and edges.count() == 5
    requests, runs = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3"), (None, "2")], "a string, b string"), spark.createDataFrame([("x", "9", "r1"), ("q", "2", "r2"), ("q", "2", "r3")], "a string, b string, r string")
    assert {tuple(r) for r in graph.reusable(requests, runs, "a", "b", "r").collect()} == {("x", "1", "r1", "a"), ("y", "2", "r2", "b"), ("z", "3", None, None), (None, "2", "r2", "b")}
    held = spark.createDataFrame([("a", "running", "w", 5), ("b", "running", "w", 50), ("c", "pending", None, None)], "id string, status string, worker_id string, lease_expires_at int")
    assert {tuple(r) for r in graph.expired(held, F.lit(10)).collect()} == {("a", "pending", None, None), ("b", "running", "w", 50), ("c", "pending", None, None)}
    left = graph.without({"jobs": (held, "id")}, spark.createDataFrame([("a",), ("a",), (None,)], "x string"))
    assert {r.id for r in left["jobs"].collect()} == {"b", "c"}
