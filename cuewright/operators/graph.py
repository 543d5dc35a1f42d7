"""Queues, dependencies and references between rows, as joins and fixpoints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cuewright.operators.ordered import cell, join_one
from cuewright.staging import stage


def progress(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every run with its number of jobs and of completed ones; a run without jobs has none. Counted before the join."""
    counts = jobs.groupBy("run_id").agg(F.count("job_id").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return runs.join(counts, "run_id", "left").select(*runs.columns, zero("completed"), zero("total"))


def ready(jobs: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending jobs all of whose dependencies are completed, by priority and id; ``limit`` takes the first ones of that order."""
    open_ = edges.join(jobs.where("status = 'completed'").select(F.col("job_id").alias("depends_on")), "depends_on", "left_anti")
    found = jobs.where("status = 'pending'").join(open_.select("job_id").distinct(), "job_id", "left_anti").select("job_id", "run_id", "priority")
    return found if limit is None else found.orderBy("priority", "job_id").limit(limit)


def dependency_results(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """Results of the completed jobs that each job depends on: ``job_id, depends_on, result``."""
    done = jobs.where("status = 'completed' AND result IS NOT NULL").select(F.col("job_id").alias("depends_on"), "result")
    return edges.join(done, "depends_on").select("job_id", "depends_on", "result")


def reached(edges: DataFrame, roots: DataFrame, through: DataFrame | None = None) -> DataFrame:
    """All that follows from ``roots`` (one column ``job_id``) along ``edges`` (``depends_on`` -> ``job_id``), roots left out.

    Steps double: what is within 2^k edges of a root, and edges that span exactly 2^k, give what is within twice that. A
    path of n takes log2(n) rounds, and rounds end only when one finds nothing new. Each is written so that lineage stays
    short. ``through`` limits what may be reached (and passed).
    """
    edges = edges.where("job_id IS NOT NULL AND depends_on IS NOT NULL").select("job_id", "depends_on").distinct()
    if through is not None:
        edges = edges.join(through.select("job_id"), "job_id", "left_semi")
    spans = stage(edges, "edges")
    roots = stage(roots.where("job_id IS NOT NULL").select("job_id").distinct(), "roots")
    seen, n = roots, -1
    while True:
        step = spans.join(seen.withColumnRenamed("job_id", "depends_on"), "depends_on", "left_semi").select("job_id")
        seen = stage(seen.unionByName(step).distinct(), "reached")
        n, before = seen.count(), n
        if n == before:
            return seen.join(roots, "job_id", "left_anti")
        a, b = spans.alias("a"), spans.alias("b")
        twice = a.join(b, F.col("a.job_id") == F.col("b.depends_on")).select(F.col("b.job_id").alias("job_id"), F.col("a.depends_on").alias("depends_on"))
        spans = stage(twice.distinct(), "edges")


def blocked(jobs: DataFrame, edges: DataFrame, failed: tuple[str, ...] = ("failed", "blocked_auth", "failed_runtime")) -> DataFrame:
    """Pending jobs that can't run because something they depend on failed, at any distance: ``job_id``."""
    return reached(edges, jobs.where(F.col("status").isin(*failed)), through=jobs.where("status = 'pending'"))


def newest(rows: DataFrame, key: str, at: str, tie: str, keep: list[str]) -> DataFrame:
    """Of each key the row latest in ``at``, of equals the largest ``tie``. Combined before the shuffle."""
    top = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*dict.fromkeys([at, tie, *keep]))).alias("t"))
    return top.select(key, *[F.col("t").getField(k).alias(k) for k in dict.fromkeys([at, tie, *keep])])


def newest_first(rows: DataFrame, at: str, tie: str, limit: int) -> DataFrame:
    """The ``limit`` rows latest in ``at``, of equals the least ``tie`` first: adds ``place`` from 1."""
    top = rows.orderBy(F.col(at).desc(), tie).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col(at).desc(), tie)))  # limit rows


def map_names(rows: DataFrame, key: str, maps: str) -> DataFrame:
    """All names in the maps of each key, sorted: ``key, names``. Each name is one before anything is shuffled."""
    each = rows.select(key, F.explode(F.map_keys(maps)).alias("name")).distinct()
    return each.groupBy(key).agg(F.sort_array(F.collect_list("name")).alias("names"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows of both tables with each key once: the one latest in ``at``, of equals the new one."""
    columns = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    top = both.groupBy(*keys).agg(F.max(F.struct(at, "_new", *[c for c in columns if c != at])).alias("t"))
    return top.select(*[F.col(c) if c in keys else F.col("t").getField(c).alias(c) for c in old.columns])


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows and those new ones whose key the old don't hold; of new rows with one key the least."""
    columns = [c for c in old.columns if c not in keys]
    fresh = new.join(old.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min(F.struct(*columns)).alias("t"))
    return old.unionByName(fresh.select(*[F.col(c) if c in keys else F.col("t").getField(c).alias(c) for c in old.columns]))


def exclusive(rows: DataFrame, key: str, selected: DataFrame, by: str) -> DataFrame:
    """Values of ``key`` that only rows whose ``by`` is in ``selected`` refer to: a semi-join less an anti-join."""
    each, chosen = rows.select(key, by).distinct(), selected.select(by).distinct()
    mine = join_one(each, chosen, by, key, "left_semi").select(key).distinct()
    others = join_one(each, chosen, by, key, "left_anti").select(key).distinct()
    return mine.where(F.col(key).isNotNull()).join(others, key, "left_anti")


def referenced(*columns: DataFrame) -> DataFrame:
    """Distinct non-null values of several one-column tables: ``digest``."""
    out = columns[0].toDF("digest")
    for c in columns[1:]:
        out = out.union(c.toDF("digest"))
    return out.where("digest IS NOT NULL").distinct()


STREAK = 10


def limit_after(events: DataFrame, key: str, at: str, tie: str, success: str, ceiling: int) -> DataFrame:
    """The limit of each key after its events in order: ``key, current_limit, success_streak``.

    A limit starts at the ceiling, halves (to 1 at least) on a failure, and grows by 1 up to the ceiling after ten
    successes in a row. There are few states, so a stretch of events is a table from state to state, and tables can be
    composed: tasks build those of single days in any order, and only they are put in order per key.
    """
    states = ceiling * STREAK
    limit, streak = np.arange(states) // STREAK + 1, np.arange(states) % STREAK
    full = streak == STREAK - 1
    step = {True: (np.where(full, np.minimum(ceiling, limit + 1), limit) - 1) * STREAK + np.where(full, 0, streak + 1), False: (np.maximum(1, limit // 2) - 1) * STREAK}

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, table = None, np.arange(states)
        for b in batches:
            out = []
            for k, c, ok in zip(b["_key"].tolist(), b["_cell"].tolist(), b["_ok"].tolist()):
                if (k, c) != now:
                    if now is not None:
                        out.append((*now, table))
                    now, table = (k, c), np.arange(states)
                table = step[ok][table]
            if out:
                yield pd.DataFrame(out, columns=["_key", "_cell", "_table"])
        if now is not None:
            yield pd.DataFrame([(*now, table)], columns=["_key", "_cell", "_table"])

    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(success).isNotNull()).select(
        F.col(key).alias("_key"), F.col(at).alias("_at"), F.col(tie).alias("_tie"), F.col(success).alias("_ok"), cell(F.unix_micros(F.col(at).cast("timestamp")), 86_400_000_000).alias("_cell")
    )
    made = rows.repartition("_key", "_cell").sortWithinPartitions("_key", "_cell", "_at", "_tie").mapInPandas(tables, f"_key {kind}, _cell bigint, _table array<int>")
    inorder = made.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_cell", "_table"))).alias("t"))  # one row a day
    last = F.aggregate("t", F.lit((ceiling - 1) * STREAK), lambda s, x: F.element_at(x["_table"], s + 1))
    return inorder.select(F.col("_key").alias(key), last.alias("_s")).select(key, (F.floor(F.col("_s") / STREAK) + 1).cast("int").alias("current_limit"), (F.col("_s") % STREAK).cast("int").alias("success_streak"))


def map_sums(rows: DataFrame, key: str, usage: str) -> DataFrame:
    """Key-wise sums of maps: ``key, usage`` as a map, names in order."""
    each = rows.select(key, F.explode(usage).alias("name", "n")).groupBy(key, "name").agg(F.sum("n").alias("n"))
    return each.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("usage"))


def hash_ordered(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Letters for the conditions of each group in an order that their hash decides: adds ``letter``."""
    by = Window.partitionBy(group).orderBy(F.sha2(F.concat_ws(":", F.col(group), F.col(name)), 256), name)
    return rows.withColumn("letter", F.chr(64 + F.row_number().over(by)))


def repeat_statistics(observations: DataFrame, keys: list[str], metric: str, value: str) -> DataFrame:
    """Median and sample variance per metric over repeats, which a missing metric doesn't count for; one repeat has variance 0."""
    return observations.where(F.col(value).isNotNull()).groupBy(*keys, metric).agg(F.count("*").alias("repeats"), F.median(value).alias("median"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance"))


def analysis_graph(topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and edges of the analysis of each source: its topics, then its chapters, then the whole.

    ``topics``: ``source_id, chapter_id, topic_id``. Jobs: ``source_id, job_id, kind, priority``, later stages first;
    edges: ``job_id, depends_on``.
    """
    name = lambda kind, *c: F.concat_ws(":", "source_id", F.lit(kind), *c)
    each = topics.where("source_id IS NOT NULL AND topic_id IS NOT NULL").select("source_id", "chapter_id", name("topic", "topic_id").alias("t"), name("chapter", "chapter_id").alias("c"), name("compose").alias("p")).distinct()
    chapters = each.select("source_id", "c", "p").distinct()
    job = lambda df, c, kind, priority: df.select("source_id", F.col(c).alias("job_id"), F.lit(kind).alias("kind"), F.lit(priority).alias("priority"))
    jobs = job(each, "t", "topic", 20).unionByName(job(chapters, "c", "chapter", 10)).unionByName(job(chapters.select("source_id", "p").distinct(), "p", "compose", 5))
    edge = lambda df, a, b: df.select(F.col(a).alias("job_id"), F.col(b).alias("depends_on"))
    return jobs, edge(each, "c", "t").unionByName(edge(chapters, "p", "c"))


def reusable(requests: DataFrame, runs: DataFrame, first: str, second: str, result: str) -> DataFrame:
    """Adds to each request the ``result`` of an earlier run with the same ``first`` key or, failing that, the same ``second``; and ``reused``, by which.

    Each side of the two left joins has one row a key: the least result.
    """
    one = lambda key, name: runs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(result).alias(name))
    both = requests.join(one(first, "_first"), first, "left").join(one(second, "_second"), second, "left")
    by = F.when(F.col("_first").isNotNull(), first).when(F.col("_second").isNotNull(), second)
    return both.select(*requests.columns, F.coalesce("_first", "_second").alias(result), by.alias("reused"))


def expired(jobs: DataFrame, now) -> DataFrame:
    """Rows whose lease has run out become free again; others stay as they are. ``status, worker_id, lease_expires_at`` are set."""
    out = (F.col("status") == "running") & (F.col("lease_expires_at") < now)
    return jobs.withColumns({"status": F.when(out, "pending").otherwise(F.col("status")), "worker_id": F.when(~F.coalesce(out, F.lit(False)), F.col("worker_id")), "lease_expires_at": F.when(~F.coalesce(out, F.lit(False)), F.col("lease_expires_at"))})


def without(tables: dict[str, tuple[DataFrame, str]], removed: DataFrame) -> dict[str, DataFrame]:
    """Each table less the rows that belong to removed ids (one column): name -> (table, column with the id). A null id belongs to nothing."""
    ids = removed.toDF("_id").where("_id IS NOT NULL").distinct()
    return {name: df.join(ids, df[column] == ids["_id"], "left_anti") for name, (df, column) in tables.items()}
