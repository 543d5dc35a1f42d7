"""Queries over the states of jobs and runs, and look-ups in them.

Line items play jobs, as in :mod:`cuewright.plans.relation_queries`; the parity of keys decides who holds what.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuewright.functions import text as tx
from cuewright.operators import graph, queue, retention
from cuewright.sources.tables import table

NOW = "2000-01-01 00:00:00"
LEASE = 600


def _now():
    return F.to_timestamp(F.lit(NOW))


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max(F.col("l_returnflag") == "R").alias("back"), F.bool_and(F.col("l_linestatus") == "F").alias("done"), F.max("l_suppkey").alias("s"), F.max("l_partkey").alias("p"), F.max("l_shipdate").alias("t")
    )
    held = (~F.col("back")) & (~F.col("done")) & (F.col("p") % 2 == 0)
    status = F.when(F.col("back"), F.when(F.col("s") % 2 == 0, "failed").otherwise("blocked_auth")).when(F.col("done"), "completed").when(held, "running").otherwise("pending")
    job = F.format_string("%d-%d", "l_orderkey", "l_linenumber")
    return rows.select(
        job.alias("job_id"), F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("n"), F.when(F.col("l_linenumber") == 1, "compose").when(F.col("l_linenumber") < 4, "chapter").otherwise("topic").alias("kind"), F.col("l_linenumber").cast("int").alias("priority"),
        status.alias("status"), F.when(held, F.format_string("w%d", F.col("s") % 7)).alias("worker_id"), F.when(held, F.col("t").cast("timestamp")).alias("lease_expires_at"), (F.col("s") % 3).cast("int").alias("attempts"),
        F.when(F.col("done") & ~F.col("back"), F.sha2(job, 256)).alias("result"), "p", "s",
    )


def _edges(jobs: DataFrame) -> DataFrame:
    before = jobs.select("run_id", (F.col("n") + 1).alias("n"), F.col("job_id").alias("depends_on"))
    return jobs.select("run_id", "n", "job_id").join(before, ["run_id", "n"]).select("job_id", "depends_on")


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    some = lambda cond, c: F.when(cond, c).otherwise(F.lit(""))
    return rows.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("source_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        some(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("recipe"), some(F.col("o_orderkey") % 2 > 0, F.concat(F.lit("https://clips.example/"), "o_custkey")).alias("locator"),
        F.when(F.col("o_orderstatus") == "F", F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("pack"),
    )


_SHOWN = ("job_id", "status", "worker_id", "attempts", "result")


def _shown(jobs: DataFrame) -> DataFrame:
    return jobs.select(*_SHOWN, F.unix_micros("lease_expires_at").cast("string").alias("lease_us"))


def queue_claims(spark: SparkSession, folder: str) -> DataFrame:
    """The queue after a worker has claimed fifty jobs."""
    jobs = _jobs(spark, folder)
    return _shown(queue.claimed(jobs, _edges(jobs), "me", 50, _now(), LEASE))


def _attempts(jobs: DataFrame) -> DataFrame:
    error = F.when(F.col("p") % 10 == 0, "Usage limit reached").when(F.col("p") % 10 == 2, "401 Unauthorized").when(F.col("p") % 10 == 4, "timed out")
    by = F.when(F.col("s") % 5 == 0, "somebody else").otherwise(F.col("worker_id"))
    return jobs.where("status = 'running'").select("job_id", by.alias("worker_id"), "attempts", error.alias("error"), F.sha2(F.concat("job_id", F.lit("!")), 256).alias("result"))


def queue_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The queue after its workers have reported success, failure or the need of another attempt."""
    jobs = _jobs(spark, folder)
    return _shown(queue.settled(jobs, queue.reports(_attempts(jobs))))


def queue_run_states(spark: SparkSession, folder: str) -> DataFrame:
    """Runs after these reports."""
    jobs = _jobs(spark, folder)
    made = queue.runs_after(_runs(spark, folder), jobs, queue.settled(jobs, queue.reports(_attempts(jobs))), _now())
    return made.select("run_id", "status", F.unix_micros("updated_at").alias("updated_us"))


def queue_resume(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs after every run that isn't complete is resumed."""
    runs = _runs(spark, folder)
    jobs, _ = queue.resumed(_jobs(spark, folder), runs, runs.where("status <> 'completed'"), _now())
    return _shown(jobs)


def queue_leases(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs after some holders renewed their leases and the others' have run out."""
    jobs = _jobs(spark, folder)
    asked = jobs.where("status = 'running' AND p % 4 = 0").select("job_id", F.when(F.col("s") % 5 == 0, "somebody else").otherwise(F.col("worker_id")).alias("worker_id"))
    return _shown(graph.expired(queue.renewed(jobs, asked, _now(), LEASE), _now()))


def expired_leases(spark: SparkSession, folder: str) -> DataFrame:
    return queue.expired_leases(_jobs(spark, folder), _now()).select("job_id", "run_id", "worker_id")


def run_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs after packs of some were made."""
    runs = _runs(spark, folder)
    made = runs.where("run_id % 5 = 0").select("run_id", F.sha2(F.concat(F.lit("pack"), "run_id"), 256).alias("pack"))
    return queue.packed(runs, made, _now()).select("run_id", "status", "pack", F.unix_micros("updated_at").alias("updated_us"))


def export_register(spark: SparkSession, folder: str) -> DataFrame:
    runs = _runs(spark, folder).where("status = 'completed'")
    path = F.concat(F.lit("/exports/"), "source_id")
    old = runs.where("run_id % 2 = 0").select("run_id", path.alias("path"), F.lit(False).alias("verified"), "updated_at").withColumnRenamed("updated_at", "created_at")
    return queue.exported(old, runs.where("run_id % 3 = 0").select("run_id", path.alias("path")), F.to_timestamp(F.lit("2030-01-01 00:00:00"))).select("run_id", "path", "verified", F.unix_micros("created_at").alias("created_us"))


def run_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Address, recipe and pack of the runs of a list, some of which don't exist."""
    ids = table(spark, folder, "lineitem").select((F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 10_000_000).otherwise(0)).alias("run_id"))
    return queue.by_run(_runs(spark, folder), ids, "locator", "recipe", "pack")


def run_results(spark: SparkSession, folder: str) -> DataFrame:
    return queue.results_of(_jobs(spark, folder), "topic")


def runs_named(spark: SparkSession, folder: str) -> DataFrame:
    """Runs that the keys of suppliers name, as a run's or a source's."""
    return queue.runs_named(_runs(spark, folder), table(spark, folder, "supplier").select("s_suppkey"))


def run_list(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred runs changed last, numbered newest first."""
    top = graph.newest_first(_runs(spark, folder).select("run_id", "status", "updated_at"), "updated_at", "run_id", 100)
    return top.select("place", "run_id", "status")


def runtime_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers play runtimes, of which customers want one by its nation or any."""
    s = table(spark, folder, "supplier")
    probes = s.select(F.concat(F.lit("rt-"), F.col("s_nationkey")).alias("runtime_id"), F.col("s_suppkey").alias("rank"), (F.col("s_acctbal") > 0).alias("available"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") % 2 == 0).alias("ready")).where("rank % 7 < 3")
    wants = table(spark, folder, "customer").select(F.col("c_custkey").alias("request_id"), F.when(F.col("c_custkey") % 9 == 0, "auto").otherwise(F.concat(F.lit("rt-"), F.col("c_nationkey") + F.when(F.col("c_custkey") % 11 == 0, 50).otherwise(0))).alias("runtime"))
    return queue.selected_runtime(probes, wants)


def deleted_runs(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of runs, their jobs and dependencies once some runs are deleted, counted by table."""
    jobs, runs = _jobs(spark, folder), _runs(spark, folder)
    edges = _edges(jobs).withColumn("run_id", F.split("job_id", "-")[0].cast("bigint"))
    left = graph.without({"runs": (runs, "run_id"), "jobs": (jobs, "run_id"), "dependencies": (edges, "run_id")}, runs.where("source_id % 2 = 0").select("run_id"))
    out = None
    for name, df in left.items():
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.count_distinct("run_id").alias("runs"))
        out = one if out is None else out.unionByName(one)
    return out


def digests_beside(spark: SparkSession, folder: str) -> DataFrame:
    """Digests that something refers to, the results and packs of some runs not counted."""
    jobs, runs = _jobs(spark, folder), _runs(spark, folder)
    gone = runs.where("source_id % 2 = 0").select("run_id")
    rows = jobs.select("run_id", "result").unionByName(runs.select("run_id", F.col("pack").alias("result")))
    return graph.referenced(rows.join(gone, "run_id", "left_anti").select("result"))


def retention_plans(spark: SparkSession, folder: str) -> DataFrame:
    """What each policy removes of logs, temporary files and objects, by reason."""
    e = table(spark, folder, "events")
    at = F.col("ts").cast("timestamp")
    files = e.where("event_type IN ('error', 'view')").select(F.concat(F.lit("/f/"), "event_id").alias("path"), F.when(F.col("event_type") == "error", "log").otherwise("temporary").alias("kind"), at.alias("modified_at"), F.col("event_id").alias("size"))
    objects = e.where("event_type = 'click'").select(F.sha2(F.col("event_id").cast("string"), 256).alias("digest"), at.alias("modified_at"), F.col("event_id").alias("size"), (F.col("user_id") % 10).alias("run_id"))
    referenced = objects.where("run_id < 4").select("run_id", "digest")
    exported = referenced.where("run_id < 2").select("run_id").distinct()
    out = None
    for policy in ("compact", "private", "archive"):
        made = retention.plan(policy, objects, files, referenced, exported, F.to_timestamp(F.lit("2024-01-20 00:00:00")))
        one = made.groupBy("reason").agg(F.count("*").alias("items"), F.sum("size").alias("freed"), F.min("item").alias("first")).withColumn("policy", F.lit(policy))
        out = one if out is None else out.unionByName(one)
    return out


def metric_names(spark: SparkSession, folder: str) -> DataFrame:
    """All names that a group's maps of metrics have, and the metadata of its last repeat."""
    rows = table(spark, folder, "events").select("user_id", F.create_map(F.col("event_type"), F.col("value"), F.concat(F.col("event_type"), F.lit("_2")), F.col("value")).alias("metrics"), F.col("event_id").alias("repeat"), "props")
    names = graph.map_names(rows, "user_id", "metrics").select("user_id", F.array_join("names", ",").alias("names"))
    return names.join(graph.newest(rows, "user_id", "repeat", "repeat", ["props"]).select("user_id", F.col("props").alias("metadata")), "user_id")


def relative_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user as spans of one trace: when each begins after the first, in microseconds."""
    rows = table(spark, folder, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = rows.groupBy("user_id").agg(F.min("us").alias("first"))
    return rows.join(first, "user_id").select("event_id", (F.col("us") - F.col("first")).alias("after_us"))


def index_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Of each order's sets of parts and suppliers what they share, and whether they are equal."""
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 20).alias("a"), F.collect_set(F.col("l_suppkey") % 20).alias("b"))
    return rows.select("l_orderkey", F.array_join(F.array_sort(F.array_intersect("a", "b")).cast("array<string>"), ",").alias("shared"), ((F.size(F.array_except("a", "b")) == 0) & (F.size(F.array_except("b", "a")) == 0)).alias("equal"))


# The conditions that are compared: id, what they are called, and what they read.
CONDITIONS = (
    ("gemini-direct-simple", "Gemini direct URL / simple prompt", "video_url"),
    ("gemini-direct-schema", "Gemini direct URL / matched schema", "video_url"),
    ("kit-gemini", "Hierarchical pipeline / Gemini", "transcript"),
    ("kit-configured", "Hierarchical pipeline / configured runtime", "transcript"),
)


def condition_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(list(CONDITIONS), "id string, label string, input_method string")


def retry_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of failed attempts, and what a process's output says."""
    said = F.when(F.col("event_id") % 6 == 0, "Usage limit reached").when(F.col("event_id") % 6 == 1, "Error 401: UNAUTHORIZED").when(F.col("event_id") % 6 == 2, "HTTP 429").when(F.col("event_id") % 6 == 3, "")
    rows = table(spark, folder, "events").select("event_id", said.alias("said"), (F.col("user_id") % 3).alias("attempts"))
    return rows.select("event_id", tx.retry_decision(F.coalesce("said", F.lit("timed out")), F.col("attempts")).alias("decision"), tx.outcome(F.col("said"), F.lit("Not logged in")).alias("outcome"))


def utc_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", tx.utc_text(F.col("created_at")).alias("created"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        queue_claims, queue_reports, queue_run_states, queue_resume, queue_leases, expired_leases, run_packs, export_register, run_lookup, run_results, runs_named, run_list, runtime_choice, deleted_runs, digests_beside,
        retention_plans, metric_names, relative_spans, index_sets, condition_catalog, retry_outcomes, utc_texts,
    )
}

_JOBS = """
    l AS (SELECT l_orderkey, l_linenumber, max(l_returnflag = 'R') AS back, bool_and(l_linestatus = 'F') AS done, max(l_suppkey) AS s, max(l_partkey) AS p, max(l_shipdate) AS t FROM lineitem GROUP BY 1, 2),
    jobs AS (SELECT l_orderkey || '-' || l_linenumber AS job_id, l_orderkey AS run_id, l_linenumber AS n, CASE WHEN l_linenumber = 1 THEN 'compose' WHEN l_linenumber < 4 THEN 'chapter' ELSE 'topic' END AS kind, l_linenumber AS priority,
             CASE WHEN back THEN CASE WHEN s % 2 = 0 THEN 'failed' ELSE 'blocked_auth' END WHEN done THEN 'completed' WHEN p % 2 = 0 THEN 'running' ELSE 'pending' END AS status,
             CASE WHEN NOT back AND NOT done AND p % 2 = 0 THEN 'w' || s % 7 END AS worker_id, CASE WHEN NOT back AND NOT done AND p % 2 = 0 THEN epoch_us(t) END AS lease_us, CAST(s % 3 AS INTEGER) AS attempts,
             CASE WHEN done AND NOT back THEN sha256(l_orderkey || '-' || l_linenumber) END AS result, p, s FROM l),
    edges AS (SELECT a.job_id, a.run_id, b.status AS before FROM jobs a JOIN jobs b ON a.run_id = b.run_id AND a.n = b.n + 1)
"""
_RUNS = """
    runs AS (SELECT o_orderkey AS run_id, o_custkey AS source_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, epoch_us(o_orderdate) AS updated_us,
             CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE '' END AS recipe, CASE WHEN o_orderkey % 2 > 0 THEN 'https://clips.example/' || o_custkey ELSE '' END AS locator,
             CASE WHEN o_orderstatus = 'F' THEN sha256(CAST(o_orderkey AS VARCHAR)) END AS pack FROM orders)
"""
_US = f"epoch_us(TIMESTAMP '{NOW}')"
_REPORTED = """,
    rp AS (SELECT job_id, CASE WHEN p % 10 = 2 THEN 'blocked_auth' WHEN p % 10 = 0 OR (p % 10 = 4 AND attempts >= 2) THEN 'failed_runtime' WHEN p % 10 = 4 THEN 'pending' ELSE 'completed' END AS now FROM jobs WHERE status = 'running' AND s % 5 <> 0),
    st AS (SELECT j.*, now, CASE WHEN now IS NULL THEN result WHEN now = 'completed' THEN sha256(job_id || '!') ELSE result END AS result2 FROM jobs j LEFT JOIN rp USING (job_id))
"""
SQL: dict[str, str] = {
    "queue_claims": f"""
        WITH {_JOBS}, c AS (SELECT job_id FROM jobs j WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.job_id = j.job_id AND before <> 'completed') ORDER BY priority, job_id LIMIT 50)
        SELECT job_id, CASE WHEN c.job_id IS NULL THEN status ELSE 'running' END AS status, CASE WHEN c.job_id IS NULL THEN worker_id ELSE 'me:' || job_id || ':' || (attempts + 1) END AS worker_id,
               CASE WHEN c.job_id IS NULL THEN attempts ELSE attempts + 1 END AS attempts, result, CASE WHEN c.job_id IS NULL THEN lease_us ELSE {_US} + {LEASE} * 1000000 END AS lease_us FROM jobs LEFT JOIN c USING (job_id)
    """,
    "queue_reports": f"WITH {_JOBS}{_REPORTED} SELECT job_id, coalesce(now, status) AS status, CASE WHEN now IS NULL THEN worker_id END AS worker_id, attempts, result2 AS result, CASE WHEN now IS NULL THEN lease_us END AS lease_us FROM st",
    "queue_run_states": f"""
        WITH {_JOBS}{_REPORTED},{_RUNS}, f AS (SELECT run_id, min(now) AS s FROM st WHERE now IN ('failed', 'blocked_auth', 'failed_runtime') GROUP BY 1)
        SELECT run_id, coalesce(s, status) AS status, CASE WHEN s IS NULL THEN updated_us ELSE {_US} END AS updated_us FROM runs LEFT JOIN f USING (run_id)
    """,
    "queue_resume": f"""
        WITH {_JOBS},{_RUNS}, x AS (SELECT j.*, j.status IN ('failed', 'blocked_auth') AND coalesce(r.status <> 'completed', false) AS hit FROM jobs j LEFT JOIN runs r USING (run_id))
        SELECT job_id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN NOT hit THEN worker_id END AS worker_id, attempts, result, CASE WHEN NOT hit THEN lease_us END AS lease_us FROM x
    """,
    "queue_leases": f"""
        WITH {_JOBS}, x AS (SELECT *, CASE WHEN status = 'running' AND p % 4 = 0 AND s % 5 <> 0 THEN {_US} + {LEASE} * 1000000 ELSE lease_us END AS u FROM jobs), y AS (SELECT *, coalesce(status = 'running' AND u < {_US}, false) AS out FROM x)
        SELECT job_id, CASE WHEN out THEN 'pending' ELSE status END AS status, CASE WHEN NOT out THEN worker_id END AS worker_id, attempts, result, CASE WHEN NOT out THEN u END AS lease_us FROM y
    """,
    "expired_leases": f"WITH {_JOBS} SELECT job_id, run_id, worker_id FROM jobs WHERE status = 'running' AND lease_us < {_US}",
    "run_packs": f"WITH {_RUNS} SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN run_id % 5 = 0 THEN sha256('pack' || run_id) ELSE pack END AS pack, CASE WHEN run_id % 5 = 0 THEN {_US} ELSE updated_us END AS updated_us FROM runs",
    "export_register": f"""
        WITH {_RUNS} SELECT run_id, '/exports/' || source_id AS path, run_id % 3 = 0 AS verified, CASE WHEN run_id % 3 = 0 THEN epoch_us(TIMESTAMP '2030-01-01') ELSE updated_us END AS created_us
        FROM runs WHERE status = 'completed' AND (run_id % 2 = 0 OR run_id % 3 = 0)
    """,
    "run_lookup": f"""
        WITH {_RUNS}, i AS (SELECT DISTINCT l_orderkey + CASE WHEN l_linenumber = 7 THEN 10000000 ELSE 0 END AS run_id FROM lineitem)
        SELECT run_id, nullif(locator, '') AS locator, nullif(recipe, '') AS recipe, pack FROM i LEFT JOIN runs USING (run_id)
    """,
    "run_results": f"WITH {_JOBS} SELECT run_id, job_id, result FROM jobs WHERE kind = 'topic' AND status = 'completed' AND result IS NOT NULL",
    "runs_named": f"WITH {_RUNS} SELECT run_id, source_id FROM runs WHERE run_id IN (SELECT s_suppkey FROM supplier) OR source_id IN (SELECT s_suppkey FROM supplier)",
    "run_list": f"WITH {_RUNS} SELECT CAST(row_number() OVER (ORDER BY updated_us DESC, run_id) AS INTEGER) AS place, run_id, status FROM runs QUALIFY place <= 100",
    "runtime_choice": """
        WITH p AS (SELECT 'rt-' || s_nationkey AS id, s_suppkey AS rank, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 2 = 0 END AS ready FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 7 < 3),
        w AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 9 = 0 THEN 'auto' ELSE 'rt-' || (c_nationkey + CASE WHEN c_custkey % 11 = 0 THEN 50 ELSE 0 END) END AS runtime FROM customer),
        m AS (SELECT request_id, id, ready, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN ready THEN 0 WHEN ready IS NULL THEN 1 ELSE 2 END, rank, id) AS k FROM w LEFT JOIN p ON runtime = 'auto' OR runtime = id)
        SELECT request_id, CASE WHEN ready OR ready IS NULL THEN id END AS runtime_id, CASE WHEN id IS NULL THEN 'none' WHEN ready THEN 'ready' WHEN ready IS NULL THEN 'unverified' ELSE 'sign_in' END AS state, CASE WHEN NOT ready THEN id END AS blocked FROM m WHERE k = 1
    """,
    "deleted_runs": f"""
        WITH {_JOBS},{_RUNS}, k AS (SELECT run_id FROM runs WHERE source_id % 2 = 0)
        SELECT 'runs' AS "table", count(*) AS rows, count(DISTINCT run_id) AS runs FROM runs WHERE run_id NOT IN (SELECT run_id FROM k) UNION ALL SELECT 'jobs', count(*), count(DISTINCT run_id) FROM jobs WHERE run_id NOT IN (SELECT run_id FROM k)
        UNION ALL SELECT 'dependencies', count(*), count(DISTINCT run_id) FROM edges WHERE run_id NOT IN (SELECT run_id FROM k)
    """,
    "digests_beside": f"""
        WITH {_JOBS},{_RUNS}, k AS (SELECT run_id FROM runs WHERE source_id % 2 = 0)
        SELECT DISTINCT digest FROM (SELECT result AS digest FROM jobs WHERE run_id NOT IN (SELECT run_id FROM k) UNION ALL SELECT pack FROM runs WHERE run_id NOT IN (SELECT run_id FROM k)) WHERE digest IS NOT NULL
    """,
    "retention_plans": """
        WITH f AS (SELECT '/f/' || event_id AS item, CASE event_type WHEN 'error' THEN 'expired_log' ELSE 'expired_temporary_media' END AS reason, event_id AS size FROM events
                   WHERE (event_type = 'error' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 30 DAY) OR (event_type = 'view' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 1 DAY)),
        o AS (SELECT sha256(CAST(event_id AS VARCHAR)) AS item, ts, event_id AS size, user_id % 10 AS run_id FROM events WHERE event_type = 'click'),
        a AS (SELECT 'compact' AS policy, * FROM f UNION ALL SELECT 'private', * FROM f UNION ALL SELECT 'archive', * FROM f
              UNION ALL SELECT 'compact', item, 'unreachable_object', size FROM o WHERE run_id >= 4 AND ts < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY UNION ALL SELECT 'private', item, 'private_after_export', size FROM o WHERE run_id < 2)
        SELECT policy, reason, count(*) AS items, CAST(sum(size) AS BIGINT) AS freed, min(item) AS first FROM a GROUP BY 1, 2
    """,
    "metric_names": """
        WITH n AS (SELECT user_id, event_type AS name FROM events UNION SELECT user_id, event_type || '_2' FROM events)
        SELECT user_id, string_agg(name, ',' ORDER BY name) AS names, (SELECT arg_max(props, event_id) FROM events e WHERE e.user_id = n.user_id) AS metadata FROM n GROUP BY 1
    """,
    "relative_spans": "SELECT event_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS after_us FROM events",
    "index_sets": """
        WITH a AS (SELECT l_orderkey, list_distinct(list(l_partkey % 20)) AS a, list_distinct(list(l_suppkey % 20)) AS b FROM lineitem GROUP BY 1)
        SELECT l_orderkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS shared, list_sort(a) = list_sort(b) AS equal FROM a
    """,
    "condition_catalog": "SELECT * FROM (VALUES " + ", ".join(str(c) for c in CONDITIONS) + ") t(id, label, input_method)",
    "retry_outcomes": """
        WITH r AS (SELECT event_id, event_id % 6 AS k, user_id % 3 AS attempts FROM events)
        SELECT event_id, CASE WHEN k = 1 THEN 'blocked_auth' WHEN k = 0 OR attempts >= 2 THEN 'failed_runtime' ELSE 'retry' END AS decision, CASE WHEN k IN (0, 2) THEN 'rate_limit' ELSE 'auth' END AS outcome FROM r
    """,
    "utc_texts": "SELECT doc_id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f+00:00') AS created FROM documents",
}
for _name in ("queue_claims", "queue_reports", "queue_resume", "queue_leases"):
    SQL[_name] = f"SELECT * REPLACE (CAST(lease_us AS VARCHAR) AS lease_us) FROM ({SQL[_name]})"
