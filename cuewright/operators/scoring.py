"""Scores of found key points against reference claims."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuewright.functions.text import quarter
from cuewright.operators.ordered import join_one
from cuewright.staging import stage

#: Similarity from which a point states a claim, and from which its evidence is the claim's.
STATES, SUPPORTS = 0.55, 0.45
#: Claims of a block, which meets the points of its source as a stream, and points that are compared at once.
TILE = (512, 2048)
#: Letters of points that are compared at once, and letters whose places are kept for them.
LETTERS, KEPT = 200_000, 1024
#: Points that a claim asks for at first, and how many times as many it asks for when all of these are taken.
FIRST, MORE = 8, 4


def similarity(a: object, b: object) -> float:
    """Ratio of matching stretches, without case and white space; 0 if either is empty."""
    if not isinstance(a, str) or not isinstance(b, str):
        return 0.0
    a, b = " ".join(a.casefold().split()), " ".join(b.casefold().split())
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def _clean(text: object) -> str:
    return " ".join(text.casefold().split()) if isinstance(text, str) else ""


class Tile:
    """Texts that another text is compared with at once: their letters are the bits of one long number.

    Each text begins at a byte and leaves a bit at least behind it, where the sum's carry ends. Equal texts are one.
    """

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        first_of: dict[str, int] = {}
        self.which = np.array([first_of.setdefault(t, len(first_of)) for t in texts], np.int64)
        texts = list(first_of)
        self.each = lengths = np.array([len(t) for t in texts], np.int64)
        self.lengths = lengths[self.which]
        sizes = lengths // 8 + 1
        self.starts = np.cumsum(sizes) - sizes
        self.size = int(sizes.sum())
        places = np.arange(int(lengths.sum())) + np.repeat(8 * self.starts - (np.cumsum(lengths) - lengths), lengths)
        letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        order = np.argsort(letters, kind="stable")
        found, first = np.unique(letters[order], return_index=True)
        self.places = dict(zip(found.tolist(), np.split(places[order], first[1:])))
        self.body = self._number(places)
        self.kept: dict[str, int] = {}

    def _number(self, places: np.ndarray) -> int:
        bits = np.zeros(8 * self.size, np.uint8)
        bits[places] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def _of(self, letter: str) -> int:
        if len(self.kept) >= KEPT:
            self.kept.clear()
        at = self.places.get(ord(letter))
        made = self.kept[letter] = 0 if at is None else self._number(at)
        return made

    def common(self, text: str) -> np.ndarray:
        """Lengths of the longest common subsequences of a text and these (Hyyrö's recurrence, for all of them in each sum)."""
        v = body = self.body
        kept = self.kept
        for letter in text:
            has = kept.get(letter)
            if has is None:
                has = self._of(letter)
            if has:
                met = v & has
                v = ((v + met) | (v ^ met)) & body
        left = np.bitwise_count(np.frombuffer(v.to_bytes(self.size, "little"), np.uint8))
        return (self.each - np.add.reduceat(left, self.starts, dtype=np.int64))[self.which]


class Claim:
    """A claim and its best points so far: (score, descending, and point), at most ``most`` or, with None, all that reach ``least``."""

    def __init__(self, key: int | None, text: str, least: float, most: int | None) -> None:
        self.key, self.text, self.floor, self.most = key, text, least, most
        self.best: list[tuple[float, int | None]] = []
        self.matcher: SequenceMatcher | None = None

    def compare(self, tile: Tile, points: list[int | None], free: np.ndarray | None = None) -> None:
        """Compare with texts; ``free`` tells those that count.

        What is skipped can't reach the floor: matching stretches are a common subsequence, so the ratio is at most that
        of the longest one, and that is at most the ratio of the shorter text. Equal scores are compared, since the
        lesser point is better.
        """
        m = len(self.text)
        most = 2.0 * np.minimum(m, tile.lengths) / (m + tile.lengths)
        if not m or most.max(initial=0.0) < self.floor:
            return
        bound = 2.0 * tile.common(self.text) / (m + tile.lengths)
        left = np.flatnonzero(bound >= self.floor if free is None else (bound >= self.floor) & free)
        if not len(left):
            return
        if self.matcher is None:
            self.matcher = SequenceMatcher(None, "", self.text)
        scores: dict[int, float] = {}
        for k in left[np.argsort(-bound[left], kind="stable")].tolist():
            if bound[k] < self.floor:
                break
            same = int(tile.which[k])
            if same not in scores:
                self.matcher.set_seq1(tile.texts[k])
                scores[same] = self.matcher.ratio()
            score = scores[same]
            if score >= self.floor:
                insort(self.best, (score, points[k]), key=lambda x: (-x[0], _key(x[1])))
                if self.most and len(self.best) >= self.most:
                    del self.best[self.most :]
                    self.floor = self.best[-1][0]


def _key(x: int | None) -> int:
    """Ids in Spark's order: null is the least."""
    return -(2**63) if x is None else x


#: A point of a claim; after a claim's points one row whose score tells the round, negative, and which says whether there may be more.
ASKED = "source_id string, claim_id bigint, point_id bigint, score double, more boolean"
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[k]) for n, k in (c.split() for c in schema.split(", "))])


def _asked(claims: DataFrame, points: DataFrame, most: int | None = None, round_: int = 1) -> DataFrame:
    """The points (at most ``most``) that state each claim best, among all of its source: :data:`ASKED`.

    A point with ``held`` is taken for claims after ``holder``. Claims go to blocks, each of which meets all points of
    its source as a stream in order of their length and text: a task keeps a block of claims and one tile of points.
    """
    spark = claims.sparkSession
    sizes = claims.groupBy("source_id").agg(F.ceil(F.count("*") / TILE[0]).cast("int").alias("_n"))
    own = join_one(claims, sizes, "source_id", "claim_id", "inner").select("source_id", F.pmod(F.xxhash64("claim_id"), F.col("_n")).cast("int").alias("_block"), F.lit(0).alias("_kind"), F.lit(0).alias("_length"), F.col("claim_id").alias("id"), "text", F.lit(False).alias("held"), F.lit(None).cast("bigint").alias("holder"))
    held = (F.col("held"), F.col("holder")) if "held" in points.columns else (F.lit(False), F.lit(None).cast("bigint"))
    met = join_one(points.where("text IS NOT NULL"), sizes, "source_id", "point_id", "inner").select("source_id", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_block"), F.lit(1), F.length("text"), "point_id", "text", held[0].alias("held"), held[1].alias("holder"))
    conf = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # work is no matter of bytes, so the number of tasks is given
    rows = own.union(met).repartition(max(conf, 4 * spark.sparkContext.defaultParallelism), "source_id", "_block").sortWithinPartitions("source_id", "_block", "_kind", "_length", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, mine, tile, letters = None, [], [], 0

        def meet() -> None:
            if not tile:
                return
            texts = Tile([t for _, t, _, _ in tile])
            ids = [p for p, _, _, _ in tile]
            some_held = any(h for _, _, h, _ in tile)
            is_free, holders = np.array([not h for _, _, h, _ in tile]), np.array([_key(x) for _, _, _, x in tile], np.int64)
            for c in mine:
                c.compare(texts, ids, is_free | (holders > _key(c.key)) if some_held else None)

        def found() -> Iterator[pa.RecordBatch]:
            out = [(block[0], c.key, p, s, None) for c in mine for s, p in c.best]
            if most:
                out += [(block[0], c.key, None, -float(round_), len(c.best) >= most) for c in mine]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _arrow(ASKED))], schema=_arrow(ASKED))

        for b in batches:
            for source, part, kind, _, key, text, held_, holder in zip(*(c.to_pylist() for c in b.columns)):
                if (source, part) != block:
                    meet()
                    yield from found()
                    block, mine, tile, letters = (source, part), [], [], 0
                text = _clean(text)
                if not kind:
                    mine.append(Claim(key, text, STATES, most))
                elif text:
                    tile.append((key, text, held_, holder))
                    letters += len(text)
                    if len(tile) >= TILE[1] or letters >= LETTERS:
                        meet()
                        tile, letters = [], 0
            if most is None:
                meet()
                tile, letters = [], 0
                yield from found()
                for c in mine:
                    c.best.clear()
        meet()
        yield from found()

    return rows.mapInArrow(compare, ASKED)


PAIRS = "source_id string, claim_id bigint, point_id bigint, score double, evidence_score double, distance_ms bigint, tolerance_ms bigint, timestamp_ms bigint"
_NAMES = [c.split()[0] for c in PAIRS.split(", ")]


def _described(pairs: DataFrame, claims: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs with what their claims and points tell: the columns of :data:`PAIRS`."""
    beside = points if "evidence" in points.columns else points.withColumn("evidence", F.col("text"))
    a = claims.select("source_id", "claim_id", F.col("evidence").alias("_one"), "timestamp_ms", "tolerance_ms").alias("a")
    b = beside.select("source_id", "point_id", F.col("evidence").alias("_two"), F.col("timestamp_ms").alias("_at")).alias("b")
    same = lambda x, i: (F.col(f"p.{i}").eqNullSafe(F.col(f"{x}.{i}"))) & (F.col("p.source_id") == F.col(f"{x}.source_id"))
    both = pairs.alias("p").join(a, same("a", "claim_id")).join(b, same("b", "point_id")).select("p.source_id", "p.claim_id", "p.point_id", "p.score", F.abs(F.col("a.timestamp_ms") - F.col("b._at")).alias("distance_ms"), "a.tolerance_ms", "a.timestamp_ms", "a._one", "b._two")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (b.column(c).to_pylist() for c in ("_one", "_two"))
            made = pa.array([similarity(y, x) for x, y in zip(one, two)], pa.float64())
            yield pa.RecordBatch.from_arrays([made if n == "evidence_score" else b.column(n) for n in _NAMES], schema=_arrow(PAIRS))

    return both.mapInArrow(compare, PAIRS)


def candidate_pairs(claims: DataFrame, points: DataFrame) -> DataFrame:
    """All pairs of a claim and a point of one source whose texts are similar enough.

    ``claims``: ``source_id, claim_id, text, evidence, timestamp_ms, tolerance_ms``; ``points``: ``source_id, point_id,
    text, timestamp_ms`` and, where points have it, ``evidence``; a point without the column is its own evidence. Without
    a time there is no distance, which fails the test of times and nothing else. Every claim meets every point of its
    source. Time decides nothing here. :func:`best_matches` makes the same choice from fewer pairs.
    """
    return _described(_asked(claims, points), claims, points)


def matched(pairs: DataFrame) -> DataFrame:
    """One point at most for a claim and the reverse, claims choosing in order of their id the best point still free.

    Equal scores go to the lesser point. A choice may depend on any earlier one of its source, so a source's pairs are
    read by one task in that order; it keeps nothing but the points that are taken. The result has the columns of the
    pairs.
    """
    return _chosen(pairs.select(*_NAMES), PAIRS)


def _chosen(pairs: DataFrame, schema: str) -> DataFrame:
    """:func:`matched`; of :data:`ASKED`, a claim that is left without a point keeps its last row if it may have more."""
    names = [c.split()[0] for c in schema.split(", ")]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = claim = None
        taken, served = set(), False
        waits: tuple | None = None  # the last row of a claim without a point
        for b in batches:
            keep, late = [], []
            more = b.column("more").to_pylist() if "more" in names else [None] * b.num_rows
            for i, (s, c, p, score) in enumerate(zip(*(b.column(x).to_pylist() for x in ("source_id", "claim_id", "point_id", "score")))):
                if (s, c) != (source, claim):
                    if waits:
                        late.append(waits)
                    waits = None
                    if s != source:
                        taken = set()
                    source, claim, served = s, c, False
                if score < 0:
                    waits = (s, c, None, score, True) if more[i] and not served else None
                elif not served and p not in taken:
                    taken.add(p)
                    served = True
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))
            if late:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*late), _arrow(schema))], schema=_arrow(schema))
        if waits:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(waits, _arrow(schema))], schema=_arrow(schema))

    ordered = pairs.select(*names).repartition("source_id").sortWithinPartitions("source_id", "claim_id", F.col("score").desc(), "point_id")
    return ordered.mapInArrow(choose, schema)


def best_matches(claims: DataFrame, points: DataFrame) -> DataFrame:
    """What :func:`matched` makes of all :func:`candidate_pairs`, without listing them. In a source an id is one claim's or one point's.

    Each claim asks for its best few points. Claims choose in order of their id; one whose points all go to earlier claims
    asks again, for more, and for no point that an earlier claim holds, until every claim has a point or none is left
    for it. Longer lists of earlier claims let a claim lose points but never win back one, so a point that is held by an
    earlier claim needs no second question, and the last choice is that from all pairs.
    """
    claims, points = stage(claims, "claims"), stage(points, "points")
    pairs = stage(_asked(claims, points, FIRST), "asked")
    most, round_ = FIRST, 1
    while True:
        chosen = stage(_chosen(pairs, ASKED), "chosen")
        waiting = chosen.where("score < 0").select("source_id", "claim_id")
        if waiting.isEmpty():
            return _described(chosen, claims, points)
        most, round_ = most * MORE, round_ + 1
        again = claims.alias("c").join(waiting.alias("w"), (F.col("c.source_id") == F.col("w.source_id")) & F.col("c.claim_id").eqNullSafe(F.col("w.claim_id")), "left_semi")
        holds = chosen.where("score >= 0").select("source_id", "point_id", F.col("claim_id").alias("holder"), F.lit(True).alias("held"))
        left = points.alias("p").join(holds.alias("h"), (F.col("p.source_id") == F.col("h.source_id")) & F.col("p.point_id").eqNullSafe(F.col("h.point_id")), "left").select("p.source_id", "p.point_id", "p.text", F.coalesce("h.held", F.lit(False)).alias("held"), "h.holder")
        pairs = pairs.union(stage(_asked(again, left, most, round_), "asked"))


def scores(claims: DataFrame, matches: DataFrame, lengths: DataFrame, points: DataFrame | None = None, outputs: DataFrame | None = None) -> DataFrame:
    """Per source: ``claims, matched, recall, evidence_coverage, timestamp_accuracy, quarters``; shares of its claims, quarters of four.

    With ``points`` also ``unsupported``, those that match no claim, and with ``outputs`` (``source_id, overview``)
    ``structure``: 1 where there is an overview and at least one point, else 0.
    """
    n = claims.groupBy("source_id").agg(F.count("*").alias("claims"))
    rows = join_one(matches, lengths.select("source_id", "duration_ms"), "source_id", "claim_id")
    found = rows.groupBy("source_id").agg(
        F.count("*").alias("matched"),
        F.count_if(F.col("evidence_score") >= SUPPORTS).alias("e"),
        F.count_if(F.col("distance_ms") <= F.col("tolerance_ms")).alias("t"),
        F.count_distinct(F.when(F.col("timestamp_ms").isNotNull(), quarter(F.col("timestamp_ms"), F.coalesce("duration_ms", F.lit(1))))).alias("q"),
    )
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("claims")
    both = n.join(found, "source_id", "left")
    columns = ["source_id", "claims", F.coalesce("matched", F.lit(0)).alias("matched"), share("matched").alias("recall"), share("e").alias("evidence_coverage"), share("t").alias("timestamp_accuracy"), (F.coalesce("q", F.lit(0)) / 4).alias("quarters")]
    if points is not None:
        both = both.join(points.groupBy("source_id").agg(F.count("*").alias("_points")), "source_id", "left")
        columns.append((F.coalesce("_points", F.lit(0)) - F.coalesce("matched", F.lit(0))).alias("unsupported"))
        if outputs is not None:
            both = both.join(outputs.where("source_id IS NOT NULL").groupBy("source_id").agg(F.max("overview").alias("_overview")), "source_id", "left")
            columns.append(F.when(F.col("_overview").isNotNull() & (F.col("_points") > 0), 1.0).otherwise(0.0).alias("structure"))
    return both.select(*columns)


def report(scores_: DataFrame, name: str = "source_id") -> DataFrame:
    """Scores as the lines of a Markdown table, each source's line by its own: ``name, line``. Numbers have three digits."""
    rest = [c for c in scores_.columns if c != name]
    number = lambda c, kind: F.format_number(F.col(c), 3) if kind == "double" else F.col(c).cast("string")
    kinds = dict(scores_.dtypes)
    return scores_.select(name, F.concat(F.lit("| "), F.concat_ws(" | ", F.col(name), *[F.coalesce(number(c, kinds[c]), F.lit("–")) for c in rest]), F.lit(" |")).alias("line"))
