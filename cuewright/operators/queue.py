"""States of jobs and runs as tables: each step is a projection of the table before it, joined to what happened.

Jobs have ``job_id, run_id, status, priority, worker_id, lease_expires_at, attempts, result``; runs have ``run_id, status,
updated_at, pack``. Nothing is changed in place: a step's result replaces the table. Rows with a null id keep their state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cuewright.functions.text import retry_decision
from cuewright.operators import graph

# States after a job's end that a resume starts anew, and outcomes with the states they lead to.
RESUMED = ("failed", "blocked_auth")
STATES = {"completed": "completed", "failed": "failed", "blocked_auth": "blocked_auth", "failed_runtime": "failed_runtime", "retry": "pending"}


def _changed(jobs: DataFrame, when: Column, **columns: Column) -> DataFrame:
    """The rows with new values where ``when`` holds."""
    hit = F.coalesce(when, F.lit(False))
    return jobs.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in columns.items()})


def claimed(jobs: DataFrame, edges: DataFrame, worker: str, limit: int, now: Column, lease_seconds: int) -> DataFrame:
    """All jobs after a worker has claimed the first ``limit`` ready ones: running, one attempt more, with a lease and a token of their own."""
    mine = graph.ready(jobs, edges, limit).select("job_id", F.lit(True).alias("_mine"))
    token = F.concat_ws(":", F.lit(worker), "job_id", F.col("attempts") + 1)
    both = jobs.join(mine, "job_id", "left")
    return _changed(both, F.col("_mine"), status=F.lit("running"), worker_id=token, lease_expires_at=now + F.make_interval(secs=F.lit(lease_seconds)), attempts=F.col("attempts") + 1).select(*jobs.columns)


def settled(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """All jobs after their workers' reports (``job_id, worker_id, outcome, result``).

    A report counts only if its worker holds the job, or names none; of several that count the one smallest in outcome,
    result. Outcomes are those of :data:`STATES`, others change nothing.
    """
    reports = events.where("job_id IS NOT NULL").where(F.col("outcome").isin(*STATES)).select("job_id", F.col("worker_id").alias("_by"), F.struct("outcome", "result").alias("_e"))
    owned = reports.join(jobs.where("job_id IS NOT NULL").select("job_id", F.col("worker_id").alias("_holder")), "job_id").where(F.col("_by").isNull() | (F.col("_by") == F.col("_holder")))
    one = owned.groupBy("job_id").agg(F.min("_e").alias("_e"))
    both = jobs.join(one, "job_id", "left")
    state = F.coalesce(*[F.when(F.col("_e.outcome") == k, F.lit(v)) for k, v in STATES.items()])
    none = F.lit(None)
    result = F.when(F.col("_e.outcome") == "completed", F.col("_e.result")).otherwise(F.col("result"))
    return _changed(both, F.col("_e").isNotNull(), status=state, worker_id=none, lease_expires_at=none, result=result).select(*jobs.columns)


def runs_after(runs: DataFrame, before: DataFrame, after: DataFrame, now: Column) -> DataFrame:
    """Runs take the state of a job of theirs that failed between the two tables of jobs; of several the smallest."""
    ended = after.where(F.col("status").isin("failed", "blocked_auth", "failed_runtime")).join(before.select("job_id", F.col("status").alias("_was")), "job_id").where("status <> _was")
    state = ended.groupBy("run_id").agg(F.min("status").alias("_state"))
    return _changed(runs.join(state, "run_id", "left"), F.col("_state").isNotNull(), status=F.col("_state"), updated_at=now).select(*runs.columns)


def reports(attempts: DataFrame) -> DataFrame:
    """Reports of attempts (``job_id, worker_id, attempts, error, result``): completed without an error, else by :func:`cuewright.functions.text.retry_decision`."""
    outcome = F.when(F.col("error").isNull(), "completed").otherwise(retry_decision(F.col("error"), F.col("attempts")))
    return attempts.select("job_id", "worker_id", outcome.alias("outcome"), "result")


def resumed(jobs: DataFrame, runs: DataFrame, chosen: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Jobs and runs after the ``chosen`` runs (``run_id``) are resumed: what failed or lacked a sign-in waits again."""
    mine = chosen.where("run_id IS NOT NULL").select("run_id").distinct().withColumn("_mine", F.lit(True))
    reset = _changed(jobs.join(mine, "run_id", "left"), F.col("_mine") & F.col("status").isin(*RESUMED), status=F.lit("pending"), worker_id=F.lit(None), lease_expires_at=F.lit(None))
    return reset.select(*jobs.columns), _changed(runs.join(mine, "run_id", "left"), F.col("_mine"), status=F.lit("pending"), updated_at=now).select(*runs.columns)


def renewed(jobs: DataFrame, holders: DataFrame, now: Column, lease_seconds: int) -> DataFrame:
    """Leases of running jobs whose holder (``job_id, worker_id``) asks for more time."""
    asked = holders.where("job_id IS NOT NULL AND worker_id IS NOT NULL").select("job_id", F.col("worker_id").alias("_by")).distinct()
    held = asked.join(jobs.where("status = 'running'").select("job_id", F.col("worker_id").alias("_holder")), "job_id").where("_by = _holder").select("job_id", F.lit(True).alias("_mine"))
    return _changed(jobs.join(held, "job_id", "left"), F.col("_mine"), lease_expires_at=now + F.make_interval(secs=F.lit(lease_seconds))).select(*jobs.columns)


def expired_leases(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease has run out: ``job_id, run_id, worker_id, lease_expires_at``."""
    return jobs.where((F.col("status") == "running") & (F.col("lease_expires_at") < now)).select("job_id", "run_id", "worker_id", "lease_expires_at")


def packed(runs: DataFrame, packs: DataFrame, now: Column) -> DataFrame:
    """Runs whose pack (``run_id, pack``) is made are completed; of several packs the smallest stays."""
    one = packs.where("run_id IS NOT NULL AND pack IS NOT NULL").groupBy("run_id").agg(F.min("pack").alias("_pack"))
    return _changed(runs.join(one, "run_id", "left"), F.col("_pack").isNotNull(), status=F.lit("completed"), pack=F.col("_pack"), updated_at=now).select(*runs.columns)


def exported(exports: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """The register of exports (``run_id, path, verified, created_at``) with new ones (``run_id, path``); a path that is there again is replaced."""
    return graph.upserted(exports, new.select("run_id", "path", F.lit(True).alias("verified"), at.alias("created_at")), ["run_id", "path"], "created_at")


def by_run(runs: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """``run_id`` and columns of the runs asked for; an empty text is null, an unknown run has nulls."""
    known = runs.select("run_id", *[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    return ids.select("run_id").distinct().join(known, "run_id", "left")


def results_of(jobs: DataFrame, kind: str) -> DataFrame:
    """Results of each run's completed jobs of a kind, to be read in order of ``job_id``: ``run_id, job_id, result``."""
    return jobs.where((F.col("kind") == kind) & (F.col("status") == "completed") & F.col("result").isNotNull()).select("run_id", "job_id", "result")


def runs_named(runs: DataFrame, names: DataFrame) -> DataFrame:
    """Runs that a name stands for (one column), as their own id or their source's: ``run_id, source_id``, each once."""
    (name,) = names.columns
    asked = names.select(F.col(name).cast("string").alias("_name")).where("_name IS NOT NULL").distinct()
    each = runs.select("run_id", "source_id")
    hits = [each.withColumn("_name", F.col(c).cast("string")).join(asked, "_name", "left_semi").select("run_id", "source_id") for c in ("run_id", "source_id")]
    return reduce(DataFrame.unionByName, hits).distinct()


def selected_runtime(probes: DataFrame, requests: DataFrame) -> DataFrame:
    """The runtime that serves each request (``request_id, runtime``): ``request_id, runtime_id, state``.

    ``probes``: ``runtime_id, rank, available, ready``. Of the available ones that match (``auto`` matches all) the first
    that is signed in, else the first of which that isn't known; ``state`` is ``ready`` or ``unverified``, or with a null
    runtime ``sign_in`` (with the first that lacks it in ``blocked``) or ``none``.
    """
    usable = probes.where("available").select("runtime_id", "rank", "ready")
    auto = usable.withColumn("_want", F.lit("auto")).unionByName(usable.withColumn("_want", F.col("runtime_id")))
    first = lambda cond: F.min(F.when(cond, F.struct("rank", "runtime_id")))
    best = auto.groupBy("_want").agg(first(F.col("ready")).alias("r"), first(F.col("ready").isNull()).alias("u"), first(~F.col("ready")).alias("b"))
    both = requests.join(best, requests["runtime"] == best["_want"], "left")
    state = F.when(F.col("r").isNotNull(), "ready").when(F.col("u").isNotNull(), "unverified").when(F.col("b").isNotNull(), "sign_in").otherwise("none")
    return both.select("request_id", F.coalesce("r.runtime_id", "u.runtime_id").alias("runtime_id"), state.alias("state"), F.when(state == "sign_in", F.col("b.runtime_id")).alias("blocked"))
