import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cuewright.llm import splitting
from cuewright.llm.splitting import Walk, cut, split_chapters


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 500), st.integers(1, 800), st.integers(1, 120), st.integers(0, 150), st.lists(st.integers(0, 1400)))
def test_cut(start, length, limit, overlap, marks):
    marks, end = sorted(set(marks)), start + length
    pieces = cut(start, end, limit, overlap, marks)
    over = min(overlap, limit - 1)
    assert pieces[0][0] == start and pieces[-1][1] == end
    for (a, b, natural), (c, d, _) in zip(pieces, pieces[1:]):
        assert b - a <= limit and c == b - over and c > a and d > b
        good = [m for m in marks if a + over < m <= a + limit]
        assert (natural and b == good[-1]) if good else (not natural and b == a + limit)
    assert pieces[-1][1] - pieces[-1][0] <= limit


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 300), st.integers(1, 900), st.lists(st.tuples(st.integers(1, 150), st.integers(0, 160)), min_size=1, max_size=3), st.lists(st.tuples(st.integers(0, 1200), st.integers(0, 9), st.booleans())))
def test_a_stream_is_cut_as_a_whole(start, length, policies, marks):
    end = start + length
    marks = sorted((x, w, b) for x, w, b in marks if start <= x < end)
    walk = Walk(start, end, [(str(k), *p) for k, p in enumerate(policies)])
    for x, w, b in marks:
        walk.mark(x, 0 if b else w, b)
    got = {}
    for p, _, a, z, natural, words in walk.finish():
        got.setdefault(p, []).append((a, z, natural))
        assert words == sum(w for x, w, b in marks if not b and a <= x < z)
    for k, (limit, overlap) in enumerate(policies):
        want = cut(start, end, limit, overlap, sorted({x for x, _, b in marks if b}))
        assert got.get(str(k), want) == want and (str(k) in got) == (length > limit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.booleans()), min_size=1, max_size=40), st.integers(1, 25), st.integers(0, 30))
def test_limits_in_tokens(cues, limit, overlap):
    walk = Walk(0, 10 * len(cues), [("p", limit, overlap)], tokens=True)
    sums, bounds = [0], []
    for k, (w, b) in enumerate(cues):
        walk.mark(10 * k, w, False)
        sums.append(sums[-1] + w)
        if b:
            walk.mark(10 * k + 9, 0, True)
            bounds.append(sums[-1])
    pieces = walk.finish()
    want = cut(0, sums[-1], limit, overlap, sorted(set(bounds)))
    assert [w for *_, w in pieces] == ([z - a for a, z, _ in want] if sums[-1] > limit else [])
    assert all(w <= limit for *_, w in pieces) and all(a <= z for _, _, a, z, _, _ in pieces)


def test_a_walk_keeps_no_more_than_a_piece_reaches():
    walk = Walk(0, 10**7, [("p", 1000, 100), ("q", 300, 0)])
    most = 0
    for x in range(0, 10**6, 10):
        walk.mark(x, 1, False)
        walk.mark(x + 5, 0, True)
        most = max(most, len(walk.boundaries), len(walk.offsets))
    assert most < 120


def test_chapters(spark, monkeypatch):
    stamp = lambda df, c: df.withColumn(c, F.to_timestamp(F.lit("2025-01-01")))
    rnd = random.Random(2)
    cues, at = [], 0
    for i in range(300):
        e = at + rnd.randrange(500, 9_000)
        cues.append(("s", i, at, rnd.choice([e, e, None]), rnd.choice(["and then", "it ends.", "why? ", "終わり。", None]), None))
        at = e + rnd.choice([0, 0, 3_000])
    cues += cues[:30] + [(None, 1, 0, 5, "x.", None), ("s", None, 0, 5, "x.", None)]
    segments = spark.createDataFrame(cues, "source_id string, seg_idx int, start_ms bigint, end_ms bigint, text string, speaker string")
    rows = [("s", 1, "a", "t", 0, 400_000), ("s", 2, "b", None, 400_000, None), ("s", 3, "c", "t", 900_000, None), ("bare", 1, "a", "t", 0, 100_000), ("bare", 2, "b", "t", 100_000, None), (None, 1, "a", "t", 0, 10**6)]
    chapters = stamp(spark.createDataFrame(rows + rows[:2], "source_id string, ord int, chapter_id string, title string, start_ms bigint, end_ms bigint"), "received_at")
    transcripts = stamp(spark.createDataFrame([("s", 1_000_000), ("bare", None)], "source_id string, duration_ms bigint"), "ingested_at")
    policies = spark.createDataFrame([("p", 50_000, 60_000, 5_000), ("q", 10_000, 90_000, None), ("none", 1, None, 0), ("neg", 1, -5, 0)], "policy_id string, target_ms bigint, maximum_ms bigint, overlap_ms bigint")
    rows = split_chapters(chapters, transcripts, segments, policies).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.piece):
        got.setdefault((r.policy_id, r.source_id, r.chapter_id), []).append(r)
    assert sorted(got) == [("p", "bare", "a"), ("p", "s", "a"), ("p", "s", "b"), ("p", "s", "c"), ("q", "bare", "a"), ("q", "s", "a"), ("q", "s", "b"), ("q", "s", "c")]
    spans = {("s", "a"): (0, 400_000), ("s", "b"): (400_000, 900_000), ("s", "c"): (900_000, 1_000_000), ("bare", "a"): (0, 100_000)}
    for (policy, source, chapter), pieces in got.items():
        limit, overlap = (60_000, 5_000) if policy == "p" else (90_000, 0)
        assert (pieces[0].start_ms, pieces[-1].end_ms) == spans[source, chapter] and [p.piece for p in pieces] == list(range(1, len(pieces) + 1))
        assert all(p.end_ms - p.start_ms <= limit for p in pieces) and all(b.start_ms == a.end_ms - overlap for a, b in zip(pieces, pieces[1:]))
        assert source == "s" or not any(p.natural for p in pieces[:-1])
    assert any(p.natural for p in got["p", "s", "a"][:-1])
    words = sum(len((t or "").split()) for _, i, s, _, t, _ in cues[:300] if s < 400_000)
    assert sum(p.words for p in got["q", "s", "a"]) == words
    monkeypatch.setattr(splitting, "BLOCK", 1)  # more policies than one reading serves
    assert sorted(split_chapters(chapters, transcripts, segments, policies).collect()) == sorted(rows)
    by_words = split_chapters(chapters, transcripts, segments, policies.withColumn("maximum_ms", F.lit(40).cast("bigint")).withColumn("overlap_ms", F.lit(5).cast("bigint")).limit(1), tokens=True).collect()
    assert by_words and all(r.words <= 40 for r in by_words) and {r.source_id for r in by_words} == {"s"}
    assert split_chapters(chapters.where("false"), transcripts, segments, policies).count() == 0
    assert split_chapters(chapters, transcripts, segments, policies.where("false")).count() == 0
