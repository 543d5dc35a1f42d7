"""Cleaning of transcripts and checks of their quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuewright.functions.text import clean_text, fold_text, language_accepted
from cuewright.operators.intervals import _with_reach, cell_periods
from cuewright.operators.ordered import cell, neighbour
from cuewright.sources.tables import counted_cues
from cuewright.staging import stage

#: Limits of the checks: share of the duration that cues must cover; cues from which repetition counts and the share of the
#: commonest that is too much; a gap that is too long, in ms and as a share of the duration (the larger counts).
COVERAGE, REPEATED_FROM, REPEATED, GAP_MS, GAP_SHARE = 0.6, 4, 0.5, 120_000, 0.2
# Reasons for a rejection, in the order they are listed.
REASONS = ("timestamps_not_monotonic", "coverage", "empty_text", "excessive_repetition", "large_gap")

CUE = ["source_id", "seg_idx", "start_ms", "end_ms", "text", "speaker"]


def usable_cues(segments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Cues of known sources that cover some time, each (``source_id``, ``seg_idx``) once: of differing deliveries the least.

    Null or blank texts stay; they are dropped by :func:`normalized`.
    """
    return counted_cues(segments.where("start_ms >= 0 AND end_ms > start_ms"), transcripts)


def stand_in(text: Column) -> Column:
    """Of any text a short one that is equal where the texts are, and ends like it: by a mark or not."""
    return F.concat(F.base64(F.unhex(F.md5(text))), F.regexp_extract(F.rtrim(text), r"([.?!])\z", 1))


def normalized(cues: DataFrame, short: bool = False) -> DataFrame:
    """Cues with clean text in order of time, repeated neighbours that touch joined to one: ``source_id, seg_idx, start_ms, end_ms, text, speaker``.

    Neighbours are joined while their text is equal and each starts no later than the joined cue ends; the first's
    index, start and speaker stay, and the last end. Blank cues are dropped first.

    All of it happens within (source, hour), after one shuffle. Only an hour's last cue, and the run of equal texts that
    it begins with, can be joined across hours; these few are put in order per source. With ``short`` texts are replaced
    by a :func:`stand_in` before they are shuffled, for those who need no more of them, and speakers are left out.
    """
    order = ["start_ms", "end_ms", "seg_idx"]
    key = ["source_id", "_cell"]
    clean = cues.select("source_id", "seg_idx", "start_ms", "end_ms", clean_text(F.col("text")).alias("text"), "speaker").where("text <> ''").withColumn("_cell", cell(F.col("start_ms")))
    if short:
        clean = clean.withColumn("text", stand_in(F.col("text"))).withColumn("speaker", F.lit(None).cast("string"))
    in_cell = Window.partitionBy(*key).orderBy(*order)
    new = F.when(F.lag("text").over(in_cell) == F.col("text"), 0).otherwise(1)
    runs = clean.withColumn("_new", new).withColumn("_run", F.sum("_new").over(in_cell))
    joined = _islands(runs, [*key, "_run"], order)
    marked = joined.withColumn("_edge", (F.col("_run") == 1) | (F.max(F.struct("_run", "_island")).over(Window.partitionBy(*key)) == F.struct("_run", "_island")))
    held = stage(marked, "islands")

    # across hours: the last cue of an hour, and those after it that begin the next one, are one run if their text is equal
    edges = held.where("_edge").withColumn("_hour_run", F.col("_run")).drop("_run", "_island")
    along = Window.partitionBy("source_id").orderBy(*order)
    new = F.when((F.col("_hour_run") == 1) & (F.lag("text").over(along) == F.col("text")), 0).otherwise(1)
    again = edges.withColumn("_new", new).withColumn("_run", F.sum("_new").over(along))
    both = held.where("NOT _edge").select(*CUE).unionByName(_islands(again, ["source_id", "_run"], order).select(*CUE))
    return both


def _islands(runs: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of a run (``key``) joined while each starts no later than the end so far; adds the number ``_island``."""
    near = Window.partitionBy(*key).orderBy(*order)
    reach = F.max("end_ms").over(near.rowsBetween(Window.unboundedPreceding, -1))
    broken = runs.withColumn("_break", F.when(F.col("start_ms") <= reach, 0).otherwise(1)).withColumn("_island", F.sum("_break").over(near))
    one = broken.groupBy(*key, "_island").agg(F.min_by(F.struct("seg_idx", "start_ms", "text", "speaker"), F.struct(*order)).alias("f"), F.max("end_ms").alias("end_ms"))
    return one.select(*key, "_island", "f.seg_idx", "f.start_ms", "end_ms", "f.text", "f.speaker")


def covered(cues: DataFrame) -> DataFrame:
    """Milliseconds per source that at least one cue covers: ``source_id, covered_ms``."""
    periods = _with_reach(cell_periods(cues, "source_id", "start_ms", "end_ms"))
    own = F.greatest(F.lit(0), F.col("_end") - F.greatest("_start", "_reach"))
    return periods.groupBy(F.col("_key").alias("source_id")).agg(F.sum(own).cast("bigint").alias("covered_ms"))


def largest_gaps(cues: DataFrame, durations: DataFrame) -> DataFrame:
    """Longest stretch per source before the first cue, between neighbours in order of start, or after the last: ``source_id, gap_ms``.

    Between neighbours the end of the cue just before counts, not the latest end so far. Without a duration nothing
    after the last cue counts.
    """
    by = ["start_ms", "seg_idx"]
    near = neighbour(cues.select("source_id", "seg_idx", "start_ms", "end_ms").withColumn("_cell", cell(F.col("start_ms"))), ["source_id"], by, ["end_ms"], "_prev_")
    per = near.groupBy("source_id").agg(F.max(F.col("start_ms") - F.coalesce("_prev_end_ms", F.lit(0))).alias("_inner"), F.max_by("end_ms", F.struct(*by)).alias("_last"))
    return per.join(durations, "source_id", "left").select("source_id", F.greatest("_inner", F.col("duration_ms") - F.col("_last")).cast("bigint").alias("gap_ms"))


def repetition(cues: DataFrame) -> DataFrame:
    """Cues with text per source and how often the commonest comes, without case: ``source_id, cues, most``."""
    text = fold_text(F.trim("text"))
    each = cues.where(F.trim("text") != "").groupBy("source_id", text.alias("_t")).agg(F.count("*").alias("n"))
    return each.groupBy("source_id").agg(F.sum("n").alias("cues"), F.max("n").alias("most"))


def out_of_order(cues: DataFrame) -> DataFrame:
    """Whether any cue starts before the one listed before it: ``source_id, disordered``."""
    listed = neighbour(cues.select("source_id", "seg_idx", "start_ms").withColumn("_cell", F.floor(F.col("seg_idx") / 4096).cast("bigint")), ["source_id"], ["seg_idx"], ["start_ms"], "_prev_")
    return listed.groupBy("source_id").agg(F.coalesce(F.bool_or(F.col("start_ms") < F.col("_prev_start_ms")), F.lit(False)).alias("disordered"))


def durations(cues: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``source_id, duration_ms``: the declared duration or the last end, whichever is later, of sources that have either."""
    ends = cues.groupBy("source_id").agg(F.max("end_ms").alias("_end"))
    rows = transcripts.join(ends, "source_id", "left")
    return rows.select("source_id", F.greatest("duration_ms", "_end").cast("bigint").alias("duration_ms")).where("duration_ms > 0")


def report(cues: DataFrame, length: DataFrame) -> DataFrame:
    """The checks of each source with a duration and cues: ``source_id, accepted, coverage, gap_ms, reasons``.

    The listed order is checked as delivered, all else on the given cues. ``reasons`` is an array in a fixed order.
    """
    both = length.join(covered(cues), "source_id").join(largest_gaps(cues, length), "source_id").join(out_of_order(cues), "source_id").join(repetition(cues), "source_id", "left")
    share = F.col("covered_ms") / F.col("duration_ms")
    flags = [
        F.col("disordered"),
        share < COVERAGE,
        F.col("cues").isNull(),
        (F.col("cues") >= REPEATED_FROM) & (F.col("most") / F.col("cues") > REPEATED),
        F.col("gap_ms") > F.greatest(F.lit(GAP_MS), F.rint(F.col("duration_ms") * GAP_SHARE)),
    ]
    reasons = F.filter(F.array(*[F.when(f, F.lit(r)) for f, r in zip(flags, REASONS)]), lambda r: r.isNotNull())
    return both.select("source_id", (F.size(reasons) == 0).alias("accepted"), share.alias("coverage"), "gap_ms", reasons.alias("reasons"))


def offered(candidates: DataFrame, sources: DataFrame, include_optional: bool = False) -> DataFrame:
    """Candidates (``source_id, scope, optional`` and more) that serve their source's kind (``source_id, kind``).

    Local media take those of the scope ``local``, other sources those of ``remote``, the optional ones only if asked for.
    A source without a kind counts as no local media.
    """
    kinds = sources.where("source_id IS NOT NULL").groupBy("source_id").agg(F.max(F.col("kind") == "local_media").alias("_local"))
    both = candidates.join(kinds, "source_id", "left")
    local = F.coalesce("_local", F.lit(False))
    wanted = F.when(local, F.col("scope") == "local").otherwise((F.col("scope") == "remote") & (F.lit(include_optional) | ~F.coalesce("optional", F.lit(False))))
    return both.where(wanted).drop("_local")


def resolved(candidates: DataFrame, wanted: str, checks: DataFrame | None = None) -> DataFrame:
    """Of each source's candidates (``source_id, rank, provider, language, title``, if known ``chapters``) the first that is acceptable.

    ``checks`` gives of each source, or of each ``source_id, rank``, whether its cues are ``disordered`` as delivered and the
    ``reasons`` against them once cleaned; one without a row has none. A candidate is rejected for the first that holds:
    no language (``not_available``), another language (``language_mismatch``), the order as delivered, any other reason.
    Returns ``source_id, provider, language, title, chapters, attempts``: a missing or empty title or list of chapters is
    taken from the earliest candidate before it with one; ``attempts`` lists those rejected before it with all their
    reasons. A source without an acceptable candidate has a null provider. All candidates are judged, where a caller would
    stop at the first.
    """
    rows = candidates if "chapters" in candidates.columns else candidates.withColumn("chapters", F.lit(None).cast("array<string>"))
    if checks is not None:
        rows = rows.join(checks, ["source_id", "rank"] if "rank" in checks.columns else ["source_id"], "left")
    one = lambda r: F.array(F.lit(r))
    why = F.when(F.col("language").isNull(), one("not_available")).when(~language_accepted(F.col("language"), F.lit(wanted)), one("language_mismatch"))
    if checks is not None:
        why = why.when(F.coalesce("disordered", F.lit(False)), one(REASONS[0])).when(F.coalesce(F.size("reasons"), F.lit(0)) > 0, F.col("reasons"))
    by = Window.partitionBy("source_id").orderBy("rank", "provider", "language", "title")  # a source has few candidates
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    title, chapters = F.nullif(F.col("title"), F.lit("")), F.when(F.size("chapters") > 0, F.col("chapters"))
    seen = rows.withColumn("_why", why).withColumns({"_title": F.first(title, ignorenulls=True).over(upto), "_chapters": F.first(chapters, ignorenulls=True).over(upto), "_accepted": F.sum(F.col("_why").isNull().cast("int")).over(upto)})
    before = seen.where((F.col("_accepted") == 0) | ((F.col("_accepted") == 1) & F.col("_why").isNull()))
    tried = F.when(F.col("_why").isNotNull(), F.struct("rank", "provider", F.col("_why").alias("reasons")))
    won = F.struct("provider", "language", F.coalesce(title, "_title").alias("title"), F.coalesce(chapters, "_chapters").alias("chapters"))
    made = before.groupBy("source_id").agg(F.max(F.when(F.col("_why").isNull(), won)).alias("w"), F.sort_array(F.collect_list(tried)).alias("attempts"))
    return made.select("source_id", "w.provider", "w.language", "w.title", "w.chapters", "attempts")
