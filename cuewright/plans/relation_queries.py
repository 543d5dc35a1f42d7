"""Queries over queues, dependencies, references and repeated measurements.

Orders play runs and line items their jobs: a job is a (order, line number), complete once all its rows are, and depends
on the order's line before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuewright.operators import graph
from cuewright.sources.tables import table
from cuewright.staging import stage


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("source_id"), status.alias("status"), F.col("o_orderdate").alias("updated_at"))


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.bool_and(F.col("l_linestatus") == "F").alias("done"), F.max(F.col("l_returnflag") == "R").alias("returned"), F.max("l_partkey").alias("part"))
    status = F.when(F.col("returned"), "failed").when(F.col("done"), "completed").otherwise("pending")
    number = F.format_string("%d-%d", "l_orderkey", "l_linenumber")
    return lines.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("n"), number.alias("job_id"), status.alias("status"), F.col("l_linenumber").alias("priority"), F.col("part").alias("result"))


def _edges(jobs: DataFrame) -> DataFrame:
    before = jobs.select("run_id", (F.col("n") + 1).alias("n"), F.col("job_id").alias("depends_on"))
    return jobs.select("run_id", "n", "job_id").join(before, ["run_id", "n"]).select("job_id", "depends_on")


def run_progress(spark: SparkSession, folder: str) -> DataFrame:
    return graph.progress(_runs(spark, folder).select("run_id", "status"), _jobs(spark, folder).select("run_id", "job_id", "status"))


def ready_jobs(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder)
    return graph.ready(jobs, _edges(jobs))


def ready_top(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder)
    return graph.ready(jobs, _edges(jobs), limit=100)


def dependency_results(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder)
    return graph.dependency_results(jobs, _edges(jobs))


def blocked_jobs(spark: SparkSession, folder: str) -> DataFrame:
    jobs = stage(_jobs(spark, folder), "jobs")
    return graph.blocked(jobs, _edges(jobs))


def latest_run_per_source(spark: SparkSession, folder: str) -> DataFrame:
    return graph.newest(_runs(spark, folder), "source_id", "updated_at", "run_id", ["status"])


def resumable_run(spark: SparkSession, folder: str) -> DataFrame:
    """The newest run that isn't complete."""
    open_ = _runs(spark, folder).where("status <> 'completed'")
    return open_.orderBy(F.col("updated_at").desc(), F.col("run_id").desc()).limit(1).select("run_id", "source_id", "status")


def run_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Runs per (source, status), later ones over earlier: completed ones are the stored table, the rest arrives."""
    runs = _runs(spark, folder).select("source_id", "run_id", "updated_at", "status")
    return graph.upserted(runs.where("status = 'completed'"), runs.where("status <> 'completed'"), ["source_id"], "updated_at")


def run_insert(spark: SparkSession, folder: str) -> DataFrame:
    """First come: a source keeps its completed runs, others are added only for sources without one."""
    runs = _runs(spark, folder).select("source_id", "run_id", "status")
    return graph.inserted(runs.where("status = 'completed'"), runs.where("status = 'pending'"), ["source_id"])


def exclusive_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Speaker labels that only recordings with a whisper transcript use."""
    rows = table(spark, folder, "segments").where("source_id IS NOT NULL").select("speaker", "source_id")
    mine = table(spark, folder, "transcripts").where("provenance = 'whisper' AND source_id IS NOT NULL").select("source_id").distinct()
    return graph.exclusive(rows, "speaker", mine, "source_id")


def reachable_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all texts that evidence, claims or documents refer to."""
    digest = lambda t, c: table(spark, folder, t).select(F.sha2(F.col(c), 256))
    return graph.referenced(digest("evidence", "text"), digest("reference_claims", "text"), digest("reference_claims", "evidence"), digest("documents", "text"))


def limit_fold(spark: SparkSession, folder: str) -> DataFrame:
    """A limit for each type of event: errors and small values halve it, ten others in a row raise it."""
    events = table(spark, folder, "events").select("event_type", "ts", "event_id", (F.col("value") >= 25).alias("ok"))
    return graph.limit_after(events, "event_type", "ts", "event_id", "ok", ceiling=8)


def usage_map_sum(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", F.create_map(F.col("event_type"), F.floor("value").cast("bigint")).alias("usage"))
    made = graph.map_sums(rows, "user_id", "usage")
    return made.select("user_id", F.array_join(F.transform(F.map_entries("usage"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("usage"))


def hash_ordered(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("condition")).distinct()
    return graph.hash_ordered(rows, "source", "condition")


def repeat_median_variance(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("metric"), F.col("l_quantity").alias("value"))
    made = graph.repeat_statistics(rows, ["l_suppkey"], "metric", "value")
    return made.select("l_suppkey", "metric", "repeats", "median", F.round("variance", 6).alias("variance"))


def distinct_per_run(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct values per group as a sorted list, and conditional counts."""
    rows = table(spark, folder, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("events"))
    return rows


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (run_progress, ready_jobs, ready_top, dependency_results, blocked_jobs, latest_run_per_source, resumable_run, run_upsert, run_insert, exclusive_labels, reachable_digests, limit_fold, usage_map_sum, hash_ordered, repeat_median_variance, distinct_per_run)
}

_RUNS = "runs AS (SELECT o_orderkey AS run_id, o_custkey AS source_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, o_orderdate AS updated_at FROM orders)"
_JOBS = """
    jobs AS (SELECT l_orderkey AS run_id, l_linenumber AS n, l_orderkey || '-' || l_linenumber AS job_id, CASE WHEN bool_or(l_returnflag = 'R') THEN 'failed' WHEN bool_and(l_linestatus = 'F') THEN 'completed' ELSE 'pending' END AS status,
             l_linenumber AS priority, max(l_partkey) AS result FROM lineitem GROUP BY 1, 2),
    edges AS (SELECT a.job_id, b.job_id AS depends_on, b.status AS s, b.result AS r FROM jobs a JOIN jobs b ON a.run_id = b.run_id AND a.n = b.n + 1)
"""
_READY = f"WITH {_JOBS} SELECT job_id, run_id, priority FROM jobs j WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.job_id = j.job_id AND s <> 'completed')"
SQL: dict[str, str] = {
    "run_progress": f"WITH {_RUNS},{_JOBS} SELECT r.run_id, r.status, count(*) FILTER (j.status = 'completed') AS completed, count(j.job_id) AS total FROM runs r LEFT JOIN jobs j USING (run_id) GROUP BY 1, 2",
    "ready_jobs": _READY,
    "ready_top": _READY + " ORDER BY priority, job_id LIMIT 100",
    "dependency_results": f"WITH {_JOBS} SELECT job_id, depends_on, r AS result FROM edges WHERE s = 'completed'",
    "blocked_jobs": f"""
        WITH RECURSIVE {_JOBS}, b AS (SELECT e.job_id FROM edges e JOIN jobs j USING (job_id) WHERE s = 'failed' AND j.status = 'pending'
        UNION SELECT e.job_id FROM b JOIN edges e ON e.depends_on = b.job_id JOIN jobs j ON j.job_id = e.job_id WHERE j.status = 'pending') SELECT job_id FROM b
    """,
    "latest_run_per_source": f"WITH {_RUNS} SELECT source_id, updated_at, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC, run_id DESC) AS k FROM runs) WHERE k = 1",
    "resumable_run": f"WITH {_RUNS} SELECT run_id, source_id, status FROM runs WHERE status <> 'completed' ORDER BY updated_at DESC, run_id DESC LIMIT 1",
    "run_upsert": f"WITH {_RUNS} SELECT source_id, run_id, updated_at, status FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC, status <> 'completed' DESC, run_id DESC, status DESC) AS k FROM runs) WHERE k = 1",
    "run_insert": f"""
        WITH {_RUNS} SELECT source_id, run_id, status FROM runs WHERE status = 'completed' UNION ALL
        SELECT source_id, min(run_id), 'pending' FROM runs r WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM runs c WHERE c.status = 'completed' AND c.source_id = r.source_id) GROUP BY 1
    """,
    "exclusive_labels": """
        WITH w AS (SELECT DISTINCT source_id FROM transcripts WHERE provenance = 'whisper' AND source_id IS NOT NULL)
        SELECT speaker FROM segments WHERE source_id IS NOT NULL AND speaker IS NOT NULL GROUP BY 1 HAVING bool_and(source_id IN (SELECT source_id FROM w))
    """,
    "reachable_digests": "SELECT DISTINCT digest FROM (SELECT sha256(text) AS digest FROM evidence UNION SELECT sha256(text) FROM reference_claims UNION SELECT sha256(evidence) FROM reference_claims UNION SELECT sha256(text) FROM documents) WHERE digest IS NOT NULL",
    "limit_fold": """
        WITH RECURSIVE e AS (SELECT event_type, value >= 25 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
        f AS (SELECT event_type, CAST(0 AS BIGINT) AS k, 8 AS l, 0 AS s FROM e WHERE k = 1
              UNION ALL SELECT e.event_type, e.k, CASE WHEN NOT ok THEN greatest(1, l // 2) WHEN s = 9 THEN least(8, l + 1) ELSE l END, CASE WHEN NOT ok OR s = 9 THEN 0 ELSE s + 1 END FROM f JOIN e ON e.event_type = f.event_type AND e.k = f.k + 1)
        SELECT event_type, arg_max(l, k) AS current_limit, arg_max(s, k) AS success_streak FROM f GROUP BY 1
    """,
    "usage_map_sum": "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type, n) AS usage FROM (SELECT user_id, event_type, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS n FROM events GROUP BY 1, 2) GROUP BY 1",
    "hash_ordered": "SELECT source, condition, chr(CAST(64 + row_number() OVER (PARTITION BY source ORDER BY sha256(source || ':' || condition), condition) AS INTEGER)) AS letter FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS source, event_type AS condition FROM events)",
    "repeat_median_variance": "SELECT l_suppkey, l_returnflag AS metric, count(*) AS repeats, median(l_quantity) AS median, round(coalesce(var_samp(l_quantity), 0), 6) AS variance FROM lineitem GROUP BY 1, 2",
    "distinct_per_run": "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, count(*) FILTER (event_type = 'error') AS errors, count(*) AS events FROM events GROUP BY 1",
}
