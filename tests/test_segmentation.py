import random

import pytest
from pyspark.sql import functions as F

from cuewright.operators import segmentation as sg

CUE = "source_id string, seg_idx int, start_ms bigint, end_ms bigint, text string, speaker string"
CHAPTER = "source_id string, chapter_id string, ord int, title string, start_ms bigint, end_ms bigint"


def slow_walk(start, end, target, maximum, cues):
    """All cues, every step."""
    if end - start <= maximum:
        return [end]
    out = []
    while start < end:
        aim, far = min(start + target, end), min(start + maximum, end)
        best = None
        for k, (s, e, t) in enumerate(cues):
            if max(start + 1, aim - 60_000) <= e <= min(far, aim + 60_000):
                pause = min(30_000, max(0, (cues[k + 1][0] if k + 1 < len(cues) else e) - e))
                value = ((30_000 if t.endswith((".", "?", "!")) else 0) + pause - abs(e - aim) / 4, e)
                best = value if best is None else max(best, value)
        stop = best[1] if best else aim
        if end - stop < target // 2:
            stop = end
        stop = min(stop, start + maximum)
        out.append(stop)
        start = stop
    return out


@pytest.mark.parametrize("policy", [(300_000, 600_000, 15_000), (120_000, 200_000, 15_000), (90_000, 90_000, 5_000), (40_000, 50_000, 1_000)])
def test_topics_and_their_cues(spark, policy):
    target, maximum, overlap = policy
    rnd = random.Random(sum(policy))
    cues, chapters, by = [], [], {}
    for k in range(12):
        at, mine = 0, []
        for i in range(rnd.randrange(1, 120)):
            at += rnd.choice([0, 500, 4_000, 40_000])
            e = at + rnd.choice([2_000, 8_000, 15_000, 70_000])
            mine.append((at, e, rnd.choice(["go on", "ends.", "why?"])))
            at = e
        cues += [(f"s{k}", i, *c, None) for i, c in enumerate(mine)]
        cuts = sorted({0, at, *(rnd.randrange(1, at) for _ in range(rnd.randrange(0, 4)))})
        for o, (a, b) in enumerate(zip(cuts, cuts[1:])):
            chapters.append((f"s{k}", f"c{o}", o, f"t{o}", a, b))
            by[f"s{k}", f"c{o}"] = (a, b, mine)
    cue_df = spark.createDataFrame(cues, CUE)
    found = sg.topics(spark.createDataFrame(chapters, CHAPTER), cue_df, target, maximum)
    rows = found.collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.position):
        got.setdefault((r.source_id, r.chapter_id), []).append((r.start_ms, r.end_ms))
    for key, (a, b, mine) in by.items():
        stops = slow_walk(a, b, target, maximum, mine)
        assert got[key] == list(zip([a, *stops], stops))
    held = {(r.source_id, r.topic_id): r.seg_indexes for r in sg.topic_cues(found, cue_df, overlap).collect()}
    for r in rows:
        a, _, mine = by[r.source_id, r.chapter_id]
        since = r.start_ms if r.position == 1 else max(a, r.start_ms - overlap)
        assert held[r.source_id, r.topic_id] == [i for i, c in enumerate(mine) if c[1] > since and c[0] < r.end_ms]


def test_sentence_end_near_the_target_wins(spark):
    cues = spark.createDataFrame([("s", 0, 0, 270_000, "First half.", None), ("s", 1, 280_000, 600_000, "then", None), ("s", 2, 600_000, 720_000, "rest", None)], CUE)
    chapters = spark.createDataFrame([("s", "c", 1, "t", 0, 720_000)], CHAPTER)
    first = sg.topics(chapters, cues).orderBy("position").first()
    assert (first.end_ms, first.title, first.topic_id) == (270_000, "t · 1", "c-topic-001")


def test_chapters_are_joined_only_where_there_are_too_many(spark):
    lengths = spark.createDataFrame([("few", 1_000_000), ("many", 1_000_000), ("none", 500)], "source_id string, duration_ms bigint")
    rows = [("few", f"x{k}", k, "t", k * 10, k * 10 + 10) for k in range(5)] + [("many", f"x{k}", k, f"t{k}", k * 10, k * 10 + 10) for k in range(12)] + [("many", "bad", 99, "t", 7, 7)]
    got = sg.coalesced(spark.createDataFrame(rows, CHAPTER), lengths, "detailed").orderBy("source_id", "start_ms").collect()
    by = {}
    for r in got:
        by.setdefault(r.source_id, []).append((r.chapter_id, r.title, r.start_ms, r.end_ms))
    assert [c[0] for c in by["few"]] == ["x0", "x1", "x2", "x3", "x4"]
    assert by["many"] == [("chapter-001", "t0", 0, 30), ("chapter-002", "t3", 30, 60), ("chapter-003", "t6", 60, 90), ("chapter-004", "t9", 90, 120)]
    assert by["none"] == [("full-video", "Full recording", 0, 500)]


def test_ends_of_chapters(spark):
    at = F.to_timestamp(F.lit("2025-01-01"))
    rows = [("s", "a", 1, "t", 0, None), ("s", "b", 2, "t", 50, None), ("u", "a", 1, "t", 0, None), (None, "a", 1, "t", 0, 9)]
    chapters = spark.createDataFrame(rows, CHAPTER).withColumn("received_at", at)
    transcripts = spark.createDataFrame([("s", 90), ("u", None)], "source_id string, duration_ms bigint").withColumn("ingested_at", at)
    assert {(r.source_id, r.chapter_id, r.end_ms) for r in sg.closed_chapters(chapters, transcripts).collect()} == {("s", "a", 50), ("s", "b", 90)}
