import pytest
from pyspark.sql import functions as F

from cuewright.functions import text as tx
from cuewright.operators import graph, queue

JOB = "job_id string, run_id string, kind string, status string, priority int, worker_id string, lease_expires_at timestamp, attempts int, result string, extra int"
ROWS = [
    ("a", "r", "topic", "running", 1, "w1", None, 1, None, 1), ("b", "r", "topic", "running", 1, "w2", None, 2, None, 1), ("c", "r", "chapter", "pending", 2, None, None, 0, None, 1), ("d", "q", "topic", "blocked_auth", 1, None, None, 1, None, 1),
    ("e", "q", "topic", "pending", 1, None, None, 0, None, 1), (None, "q", "topic", "pending", 1, None, None, 0, None, 1), ("f", None, "topic", "completed", 1, None, None, 1, "h", 1),
]


def now():
    return F.to_timestamp(F.lit("2025-01-01 00:00:00"))


def states(df):
    return {r.job_id: r.status for r in df.collect()}


def test_claims(spark):
    jobs = spark.createDataFrame(ROWS, JOB)
    edges = spark.createDataFrame([("c", "a")], "job_id string, depends_on string")
    made = {r.job_id: r for r in queue.claimed(jobs, edges, "me", 5, now(), 60).collect()}
    assert made["e"].status == "running" and made["e"].worker_id == "me:e:1" and made["e"].attempts == 1 and made["e"].lease_expires_at.minute == 1
    assert made["c"].status == "pending" and made["a"].worker_id == "w1" and len(made) == len(ROWS)
    assert states(queue.claimed(jobs, edges, "me", 0, now(), 60)) == states(jobs)


def test_reports_count_for_the_holder_only(spark):
    jobs = spark.createDataFrame(ROWS, JOB)
    events = spark.createDataFrame([("a", "w1", "completed", "x"), ("a", "w9", "failed", None), ("b", "w1", "completed", "x"), ("c", None, "failed", None), ("nobody", "w1", "failed", None), (None, None, "failed", None), ("d", None, "strange", None), ("a", "w1", "completed", "x")], "job_id string, worker_id string, outcome string, result string")
    made = {r.job_id: r for r in queue.settled(jobs, events).collect()}
    assert (made["a"].status, made["a"].result, made["a"].worker_id) == ("completed", "x", None) and made["b"].status == "running" and made["c"].status == "failed" and made["d"].status == "blocked_auth" and len(made) == len(ROWS)
    assert states(queue.settled(jobs, events.where("false"))) == states(jobs)
    runs = spark.createDataFrame([("r", "running", None), ("q", "running", None)], "run_id string, status string, updated_at timestamp")
    assert {(r.run_id, r.status) for r in queue.runs_after(runs, jobs, queue.settled(jobs, events), now()).collect()} == {("r", "failed"), ("q", "running")}


def test_attempts_become_reports(spark):
    rows = [("a", "w1", 1, None), ("b", "w2", 1, "timed out"), ("c", "w", 2, "timed out"), ("d", "w", 0, "Usage LIMIT reached"), ("e", "w", 5, "not logged in")]
    made = queue.reports(spark.createDataFrame([(*r, "h") for r in rows], "job_id string, worker_id string, attempts int, error string, result string")).collect()
    assert {r.job_id: r.outcome for r in made} == {"a": "completed", "b": "retry", "c": "failed_runtime", "d": "failed_runtime", "e": "blocked_auth"}


def test_resume_and_leases(spark):
    jobs = spark.createDataFrame(ROWS, JOB).withColumn("lease_expires_at", F.when(F.col("status") == "running", now() - F.expr("interval 1 day")))
    runs = spark.createDataFrame([("r", "failed", None), ("q", "failed", None), (None, "failed", None)], "run_id string, status string, updated_at timestamp")
    after, runs_after = queue.resumed(jobs, runs, runs.where("run_id = 'q' OR run_id IS NULL"), now())
    assert states(after) == states(jobs) | {"d": "pending"} and {(r.run_id, r.status) for r in runs_after.collect()} == {("r", "failed"), ("q", "pending"), (None, "failed")}
    asked = spark.createDataFrame([("a", "w1"), ("b", "w1"), (None, None)], "job_id string, worker_id string")
    renewed = queue.renewed(jobs, asked, now(), 60)
    assert [r.job_id for r in queue.expired_leases(renewed, now()).collect()] == ["b"]
    assert states(graph.expired(renewed, now()))["b"] == "pending"


def test_look_ups(spark):
    runs = spark.createDataFrame([("r", "s", "", None, None), ("s", "t", "u", "x", None)], "run_id string, source_id string, locator string, pack string, updated_at timestamp").withColumn("status", F.lit("pending"))
    assert {tuple(r) for r in queue.by_run(runs, spark.createDataFrame([("r",), ("s",), ("none",), ("r",)], "run_id string"), "locator", "pack").collect()} == {("r", None, None), ("s", "u", "x"), ("none", None, None)}
    assert {tuple(r) for r in queue.runs_named(runs, spark.createDataFrame([("s",), (None,)], "name string")).collect()} == {("r", "s"), ("s", "t")}
    assert [(r.run_id, r.pack) for r in queue.packed(runs, spark.createDataFrame([("r", "p2"), ("r", "p1"), ("r", None)], "run_id string, pack string"), now()).where("status = 'completed'").collect()] == [("r", "p1")]
    register = queue.exported(spark.createDataFrame([], "run_id string, path string, verified boolean, created_at timestamp"), spark.createDataFrame([("r", "/a"), ("r", "/a")], "run_id string, path string"), now())
    assert register.count() == 1


@pytest.mark.parametrize("want, got", [("auto", ("y", "ready", None)), ("x", ("x", "unverified", None)), ("z", (None, "sign_in", "z")), ("off", (None, "none", None)), ("nobody", (None, "none", None)), (None, (None, "none", None))])
def test_runtimes(spark, want, got):
    probes = spark.createDataFrame([("x", 1, True, None), ("y", 2, True, True), ("z", 3, True, False), ("off", 0, False, True)], "runtime_id string, rank int, available boolean, ready boolean")
    row = queue.selected_runtime(probes, spark.createDataFrame([(1, want)], "request_id int, runtime string")).first()
    assert (row.runtime_id, row.state, row.blocked) == got


def test_a_long_chain_is_reached_to_its_end(spark):
    n = 300
    edges = spark.createDataFrame([(f"j{k + 1}", f"j{k}") for k in range(n)] + [("j5", f"j{n}")], "job_id string, depends_on string")
    roots = spark.createDataFrame([("j0",), (None,)], "job_id string")
    assert {r.job_id for r in graph.reached(edges, roots).collect()} == {f"j{k}" for k in range(1, n + 1)}
    assert {r.job_id for r in graph.reached(edges, roots, spark.createDataFrame([(f"j{k}",) for k in range(1, 100)], "job_id string")).collect()} == {f"j{k}" for k in range(1, 100)}


@pytest.mark.parametrize("text, want", [('```json\n{"a": 1}\n```', '{"a": 1}'), ('{"a": 1}', '{"a": 1}'), ("[1]", None), ("3", None), ("no json {", None), ("", None), (None, None), ("null", None)])
def test_json_objects(spark, text, want):
    assert spark.range(1).select(tx.json_object(F.lit(text).cast("string"))).first()[0] == want
