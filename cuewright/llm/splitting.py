"""Cutting oversized stretches of a recording into pieces at natural boundaries."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cuewright.operators.ordered import cell, neighbour
from cuewright.operators.segmentation import closed_chapters
from cuewright.sources.tables import counted_cues
from cuewright.staging import stage

#: A pause this long between two cues is a boundary, even without the end of a sentence.
PAUSE_MS = 1_500
#: Policies that one reading of the cues serves.
BLOCK = 1_000


def cut(start: int, end: int, limit: int, overlap: int, boundaries: list[int]) -> list[tuple[int, int, bool]]:
    """Pieces (start, end, whether the end is natural) of [start, end), none longer than ``limit``.

    Each piece but the last ends at the last of the sorted ``boundaries`` that keeps it within the limit, or at the
    limit itself where none does; the next one starts ``overlap`` earlier. A boundary too near the start to leave any
    progress after the overlap isn't used. An overlap of the limit or more is reduced to one less than the limit.
    """
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    out = []
    while end - start > limit:
        i = bisect_right(boundaries, start + limit) - 1
        natural = i >= 0 and boundaries[i] > start + overlap
        stop = boundaries[i] if natural else start + limit
        out.append((start, stop, natural))
        start = stop - overlap
    out.append((start, end, True))
    return out


PIECES = "policy_id string, source_id string, chapter_id string, piece int, start_ms bigint, end_ms bigint, natural boolean, words bigint"


class Walk:
    """Cuts one chapter by several policies while its marks arrive in order of time.

    Offsets are milliseconds or, for ``tokens``, prefix sums of the words so far. Only the stretch that a piece still to
    be cut can reach is kept: the boundaries in it, sorted, and prefix sums by offset. A piece is cut once a mark
    lies beyond its limit: binary search for the last boundary within it, a step back by the overlap, or a hard cut.
    """

    def __init__(self, start: int, end: int, policies: list[tuple[str, int, int]], tokens: bool = False) -> None:
        self.tokens, self.begin, self.end = tokens, start, end
        first = 0 if tokens else start
        self.names = [p for p, _, _ in policies]
        self.limits = [(max(1, limit), max(0, min(overlap, max(1, limit) - 1))) for _, limit, overlap in policies]
        self.at = [first] * len(policies)  # where the piece to be cut begins
        self.made: list[list[tuple[int, int, bool, int]]] = [[] for _ in policies]
        self.due = first + min(limit for limit, _ in self.limits)
        self.boundaries: list[int] = []
        self.offsets: list[int] = []  # where words stand
        self.sums: list[int] = []  # words up to and with them
        self.times: list[int] = []
        self.total = 0

    def mark(self, time: int, words: int, boundary: bool) -> None:
        """A cue's start with its words, or a boundary."""
        if boundary:
            x = self.total if self.tokens else time
            if not self.boundaries or self.boundaries[-1] < x:
                self.boundaries.append(x)
        else:
            self.offsets.append(self.total if self.tokens else time)
            self.total += words
            self.sums.append(self.total)
            self.times.append(time)
            x = self.total if self.tokens else time
        if x > self.due:
            self._cut(x)

    def _cut(self, upto: int) -> None:
        for p, (limit, overlap) in enumerate(self.limits):
            start = self.at[p]
            while upto - start > limit:
                i = bisect_right(self.boundaries, start + limit) - 1
                natural = i >= 0 and self.boundaries[i] > start + overlap
                stop = self.boundaries[i] if natural else start + limit
                self._emit(p, start, stop, natural)
                start = stop - overlap
            self.at[p] = start
        self.due = min(start + limit for start, (limit, _) in zip(self.at, self.limits))
        low = min(self.at)
        del self.boundaries[: bisect_left(self.boundaries, low)]
        k = max(0, bisect_left(self.offsets, low) - 1)  # the sum before the first one stays known
        del self.offsets[:k], self.sums[:k], self.times[:k]

    def _emit(self, p: int, start: int, stop: int, natural: bool) -> None:
        before = lambda x: self.sums[k - 1] if (k := bisect_left(self.offsets, x)) else 0
        words = stop - start if self.tokens else before(stop) - before(start)
        self.made[p].append((self._time(start), self._time(stop), natural, words) if self.tokens else (start, stop, natural, words))

    def _time(self, offset: int) -> int:
        """When the cue begins that holds the word at an offset."""
        if offset <= 0 or offset >= self.total:
            return self.begin if offset <= 0 else self.end
        return self.times[bisect_right(self.offsets, offset) - 1]

    def finish(self) -> list[tuple[str, int, int, int, bool, int]]:
        """The pieces of every policy that the chapter is too long for: (policy, number, start, end, natural, words)."""
        end = self.total if self.tokens else self.end
        self._cut(end)
        out = []
        for p, pieces in enumerate(self.made):
            if pieces:
                self._emit(p, self.at[p], end, True)
                out += [(self.names[p], k, *x) for k, x in enumerate(pieces, 1)]
        return out


def _walk_batches(policies: list[tuple[str, int, int]], tokens: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks sorted by chapter and time, each chapter's first one being the chapter itself."""
    now, walk = None, None

    def rows() -> list[tuple]:
        return [(policy, *now, *rest) for policy, *rest in walk.finish()] if walk else []

    names = [x.split()[0] for x in PIECES.split(", ")]
    for b in batches:
        out: list[tuple] = []
        for source, chapter, kind, x, y in zip(*(b[c].tolist() for c in ("source_id", "chapter_id", "kind", "x", "y"))):
            if kind == 0:
                out += rows()
                now, walk = (source, chapter), Walk(x, y, policies, tokens)
            else:
                walk.mark(x, y, kind == 1)
        yield pd.DataFrame(out, columns=names)
    yield pd.DataFrame(rows(), columns=names)


def cue_boundaries(segments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Of each cue ``source_id, at, words, boundary``: its start, number of words, and its end if a sentence ends or a pause follows there, else null.

    What is needed of the texts is taken from them before anything is shuffled.
    """
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"<[^>]*>|[\[(][^\])]*[\])]|♪", " ")
    each = segments.where("start_ms IS NOT NULL").select(
        "source_id",
        "seg_idx",
        F.col("start_ms").alias("at"),
        F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms")).alias("end"),
        plain.rlike(r"[.!?。！？…][\s\"'”’»)\]*]*\z").alias("sentence"),
        F.size(F.filter(F.split(plain, r"\s+"), lambda w: w != "")).alias("words"),
    )
    rows = stage(counted_cues(each, transcripts, keep=("at", "end", "sentence", "words")), "cues")
    rows = neighbour(rows.withColumn("_cell", cell(F.col("at"))), ["source_id"], ["at", "seg_idx"], ["at"], "_next_", forward=True)
    end = F.coalesce("end", "_next_at")
    natural = F.col("sentence") | (F.col("_next_at") - end >= PAUSE_MS)
    return rows.select("source_id", "at", "words", F.when(natural, end).alias("boundary"))


def split_chapters(chapters: DataFrame, transcripts: DataFrame, segments: DataFrame, policies: DataFrame, tokens: bool = False) -> DataFrame:
    """Pieces of every valid chapter that is longer than a policy's maximum, a row a piece.

    Returns ``policy_id, source_id, chapter_id, piece, start_ms, end_ms, natural, words``. A chapter without cues is cut
    at the limit. Policies without a positive maximum are ignored, a null overlap is 0. Repeated rows, repeated cues and
    extra columns change nothing; empty tables give no rows. With ``tokens`` maximum and overlap count words instead of
    milliseconds, and a piece begins and ends with the cues that hold its first word and the first one after it.

    Cues meet chapters by (source, hour), so that one long recording is spread. A chapter's marks, two numbers each, are
    then read as a sorted stream: a task keeps no more of it than the longest piece reaches, and one reading serves all
    policies, which come in blocks of :data:`BLOCK`.
    """
    rows = policies.where("policy_id IS NOT NULL AND maximum_ms > 0").select("policy_id", F.col("maximum_ms").cast("bigint"), F.coalesce(F.col("overlap_ms").cast("bigint"), F.lit(0))).distinct().orderBy("policy_id", "maximum_ms")
    closed = closed_chapters(chapters, transcripts).select("source_id", "chapter_id", F.col("start_ms").alias("x"), F.col("end_ms").alias("y")).where("y > x")
    listed = [tuple(r) for r in rows.toLocalIterator()]
    if not listed:
        return closed.where("false").selectExpr(*(f"CAST(NULL AS {t}) AS {c}" for c, t in (x.split() for x in PIECES.split(", "))))
    least = min(r[1] for r in listed)
    long = closed if tokens else closed.where(F.col("y") - F.col("x") > least)

    cells = long.withColumn("_cell", F.explode(F.sequence(cell(F.col("x")), cell(F.col("y")))))
    of = F.array(F.struct(F.lit(2).alias("kind"), F.col("at").alias("x"), F.col("words").cast("bigint").alias("y")), F.when(F.col("boundary").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("boundary").alias("x"), F.lit(0).cast("bigint").alias("y"))))
    marks = cue_boundaries(segments, transcripts).select("source_id", F.explode(of).alias("m")).where("m IS NOT NULL").select("source_id", "m.*").withColumn("_cell", cell(F.col("x")))
    chapter = cells.withColumnsRenamed({"x": "_from", "y": "_to"})
    met = marks.join(chapter, ["source_id", "_cell"]).where("x >= _from AND x < _to").select("source_id", "chapter_id", "kind", "x", "y")
    first = long.select("source_id", "chapter_id", F.lit(0).alias("kind"), "x", "y")
    ordered = first.unionByName(met).repartition("source_id", "chapter_id").sortWithinPartitions("source_id", "chapter_id", F.col("kind") > 0, "x", "kind")
    if len(listed) > BLOCK:
        ordered = stage(ordered, "marks").repartition("source_id", "chapter_id").sortWithinPartitions("source_id", "chapter_id", F.col("kind") > 0, "x", "kind")
    out = None
    for k in range(0, len(listed), BLOCK):
        some = ordered.mapInPandas(lambda b, block=listed[k : k + BLOCK]: _walk_batches(block, tokens, b), PIECES)
        out = some if out is None else out.unionByName(some)
    return out
