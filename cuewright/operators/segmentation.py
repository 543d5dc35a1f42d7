"""Chapters and topics of recordings, and the cues they hold."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cuewright.functions.text import chapter_cap, numbered
from cuewright.operators.ordered import cell, join_one, neighbour, running
from cuewright.sources.tables import valid_chapters, valid_transcripts

#: How far from the target a topic may end, the score of a sentence's end, the longest pause that adds to it, and what distance takes off.
RADIUS_MS, SENTENCE, MOST_PAUSE, PER_MS = 60_000, 30_000, 30_000, 0.25


def closed_chapters(chapters: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Valid chapters with an end, as ``source_id, chapter_id, ord, title, start_ms, end_ms``.

    A null end is the next chapter's start or, for a source's last, the duration. Chapters without a start, or still
    without an end, are left out.
    """
    valid = valid_chapters(chapters).where("start_ms IS NOT NULL").withColumn("_cell", cell(F.col("start_ms")))
    valid = neighbour(valid, ["source_id"], ["start_ms", "ord", "chapter_id"], ["start_ms"], "_next_", forward=True)
    lengths = valid_transcripts(transcripts, ["duration_ms"])
    end = F.coalesce("end_ms", "_next_start_ms", "duration_ms")
    return join_one(valid, lengths, "source_id", "chapter_id").select("source_id", "chapter_id", "ord", "title", "start_ms", end.alias("end_ms")).where("end_ms IS NOT NULL")


def coalesced(chapters: DataFrame, lengths: DataFrame, depth: str) -> DataFrame:
    """Chapters of positive length, at most as many as the depth allows: ``source_id, chapter_id, title, start_ms, end_ms``.

    Where there are more, neighbours are joined in groups of equal size: first title and start, last end, new ids.
    Sources of ``lengths`` (``source_id, duration_ms``) without chapters get one over their whole duration.
    """
    proper = join_one(chapters.where("end_ms > start_ms"), lengths.select("source_id", "duration_ms"), "source_id", "chapter_id", "inner")
    counted = proper.groupBy("source_id").agg(F.count("*").alias("_n"))
    timed = proper.withColumn("_one", F.lit(1).cast("bigint")).withColumn("_cell", cell(F.col("start_ms")))
    numbers = running(timed, ["source_id"], ["start_ms", "ord", "chapter_id"], {"_k": ("sum", "_one")})  # chapters before each
    placed = join_one(numbers, counted, "source_id", "chapter_id", "inner").withColumn("_cap", chapter_cap(F.lit(depth), F.col("duration_ms")))
    size = F.when(F.col("_n") <= F.col("_cap"), 1).otherwise(F.ceil(F.col("_n") / F.col("_cap")))
    grouped = placed.withColumn("_g", F.floor(F.col("_k") / size).cast("bigint")).groupBy("source_id", "_g").agg(
        F.min_by(F.struct("chapter_id", "title", "start_ms"), "_k").alias("f"), F.max_by("end_ms", "_k").alias("end_ms"), F.first(F.col("_n") > F.col("_cap")).alias("_joined")
    )
    ids = F.when(F.col("_joined"), numbered("chapter", F.col("_g") + 1)).otherwise(F.col("f.chapter_id"))
    some = grouped.select("source_id", ids.alias("chapter_id"), "f.title", "f.start_ms", "end_ms")
    none = lengths.join(counted, "source_id", "left_anti").select("source_id", F.lit("full-video").alias("chapter_id"), F.lit("Full recording").alias("title"), F.lit(0).cast("bigint").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    return some.unionByName(none)


def pause_and_sentence(text: Column, pause: Column) -> Column:
    """The default boundary score of a cue's end, apart from its distance to the target."""
    return F.when(F.rtrim(text).rlike(r"[.?!]\z"), SENTENCE).otherwise(0) + F.least(F.lit(MOST_PAUSE), F.greatest(F.lit(0), pause))


class Walk:
    """Cuts one chapter into topics while its cues' ends arrive in order.

    Each topic ends at the best-scored cue's end near its target, else at the target. A rest shorter than half a target
    joins the last topic, unless that exceeds the maximum. Only ends that the next topic may still reach are kept.
    """

    def __init__(self, start: int, end: int, target_ms: int, maximum_ms: int) -> None:
        self.end, self.target, self.maximum = end, target_ms, maximum_ms
        self.stops = [start]
        self.ends: list[int] = []
        self.scores: list[int] = []
        if end - start <= maximum_ms:
            self.stops.append(end)

    def _reach(self) -> int:
        """Up to where ends decide the next stop."""
        ideal, furthest = min(self.end, self.stops[-1] + self.target), min(self.end, self.stops[-1] + self.maximum)
        return min(furthest, ideal + RADIUS_MS)

    def mark(self, end: int, score: int) -> None:
        while self.stops[-1] < self.end and end > self._reach():
            self._step()
        self.ends.append(end)
        self.scores.append(score)

    def _step(self) -> None:
        at = self.stops[-1]
        ideal = min(self.end, at + self.target)
        near = range(bisect_left(self.ends, max(at + 1, ideal - RADIUS_MS)), bisect_right(self.ends, self._reach()))
        best = max(near, key=lambda k: (self.scores[k] - abs(self.ends[k] - ideal) * PER_MS, self.ends[k]), default=None)
        stop = ideal if best is None else self.ends[best]
        stop = min(self.end if self.end - stop < self.target // 2 else stop, at + self.maximum)
        self.stops.append(stop)
        k = bisect_right(self.ends, stop)
        del self.ends[:k], self.scores[:k]

    def finish(self) -> list[int]:
        while self.stops[-1] < self.end:
            self._step()
        return self.stops[1:]


def walk(start: int, end: int, target_ms: int, maximum_ms: int, ends: list[int], scores: list[int]) -> list[int]:
    """Ends of the topics of one chapter; ``ends`` are sorted ends of cues with their ``scores``."""
    made = Walk(start, end, target_ms, maximum_ms)
    for x in zip(ends, scores):
        made.mark(*x)
    return made.finish()


TOPICS = "source_id string, chapter_id string, title string, chapter_start bigint, position int, topics int, start_ms bigint, end_ms bigint"


def topics(chapters: DataFrame, cues: DataFrame, target_ms: int = 300_000, maximum_ms: int = 600_000, score: Callable[[Column, Column], Column] = pause_and_sentence) -> DataFrame:
    """Topics of each chapter: ``source_id, chapter_id, topic_id, title, position, chapter_start, start_ms, end_ms``.

    ``cues`` are normalized; ``score`` makes a cue's boundary score from its text and the pause after it. Cues meet
    chapters by (source, hour); a chapter's ends and scores are then read as a sorted stream, of which a task keeps only
    what the next topic may reach.
    """
    if not 0 < target_ms <= maximum_ms:
        raise ValueError("a target must be positive and no longer than the maximum")
    ordered = neighbour(cues.select("source_id", "seg_idx", "start_ms", "end_ms", "text").withColumn("_cell", cell(F.col("start_ms"))), ["source_id"], ["start_ms", "end_ms", "seg_idx"], ["start_ms"], "_next_", forward=True)
    marks = ordered.select("source_id", F.col("end_ms").alias("at"), score(F.col("text"), F.coalesce("_next_start_ms", "end_ms") - F.col("end_ms")).cast("bigint").alias("score"))
    cells = chapters.where(F.col("end_ms") - F.col("start_ms") > maximum_ms).withColumn("_cell", F.explode(F.sequence(cell(F.col("start_ms")), cell(F.col("end_ms")))))
    met = marks.withColumn("_cell", cell(F.col("at"))).join(cells, ["source_id", "_cell"]).where("at > start_ms AND at <= end_ms")
    first = chapters.select("source_id", "chapter_id", F.lit(0).alias("kind"), F.col("start_ms").alias("x"), F.col("end_ms").alias("y"), "title")
    rest = met.select("source_id", "chapter_id", F.lit(1).alias("kind"), F.col("at").alias("x"), F.col("score").alias("y"), F.lit(None).cast("string").alias("title"))
    ordered = first.unionByName(rest).repartition("source_id", "chapter_id").sortWithinPartitions("source_id", "chapter_id", "kind", "x", "y")
    names = [x.split()[0] for x in TOPICS.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, made = None, None

        def rows() -> list[tuple]:
            if made is None:
                return []
            stops = made.finish()
            return [(*now, k, len(stops), a, z) for k, (a, z) in enumerate(zip([now[3], *stops], stops), 1)]

        for b in batches:
            out = []
            for source, chapter, kind, x, y, title in b.itertuples(index=False, name=None):
                if kind == 0:
                    out += rows()
                    now, made = (source, chapter, title, x), Walk(x, y, target_ms, maximum_ms)
                else:
                    made.mark(x, y)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(rows(), columns=names)

    made = ordered.mapInPandas(cut, TOPICS)
    title = F.when(F.col("topics") == 1, F.col("title")).otherwise(F.concat("title", F.lit(" · "), "position"))
    return made.select("source_id", "chapter_id", F.format_string("%s-topic-%03d", "chapter_id", "position").alias("topic_id"), title.alias("title"), "position", "chapter_start", "start_ms", "end_ms")


def topic_cues(topics_: DataFrame, cues: DataFrame, overlap_ms: int = 15_000) -> DataFrame:
    """Each topic with the cues that overlap it: ``source_id, topic_id, seg_indexes`` (ascending, empty where none).

    Topics after a chapter's first look back by the overlap, though not before the chapter. The join is by (source,
    hour); a cue or topic over several hours meets in the first hour that both touch.
    """
    looking = topics_.withColumn("_from", F.when(F.col("position") == 1, F.col("start_ms")).otherwise(F.greatest("chapter_start", F.col("start_ms") - overlap_ms)))
    spread = lambda df, a, b: df.withColumn("_cell", F.explode(F.sequence(cell(F.col(a)), F.greatest(cell(F.col(a)), cell(F.col(b) - 1)))))
    left = spread(looking.select("source_id", "topic_id", "_from", F.col("end_ms").alias("_to")), "_from", "_to")
    right = spread(cues.select("source_id", "seg_idx", "start_ms", "end_ms"), "start_ms", "end_ms")
    once = F.col("_cell") == cell(F.greatest("_from", "start_ms"))
    met = left.join(right, ["source_id", "_cell"]).where((F.col("end_ms") > F.col("_from")) & (F.col("start_ms") < F.col("_to")) & once)
    per = met.groupBy("source_id", "topic_id").agg(F.sort_array(F.collect_list("seg_idx")).alias("seg_indexes"))
    return topics_.select("source_id", "topic_id").join(per, ["source_id", "topic_id"], "left").select("source_id", "topic_id", F.coalesce("seg_indexes", F.array().cast("array<int>")).alias("seg_indexes"))
