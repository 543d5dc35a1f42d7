import random

import pytest
from hypothesis import given, settings, strategies as st

from cuewright.operators import intervals
from cuewright.operators.intervals import IntervalMap
from cuewright.streaming.intervals import newest, stream_gaps, stream_periods

SCHEMA = "source_id string, start_ms bigint, end_ms bigint"
HOUR = 3_600_000


def union(pairs):
    out = []
    for s, e in sorted(p for p in pairs if None not in p and p[1] > p[0]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 20))))
def test_map_is_the_union(pairs):
    m, total = IntervalMap(), 0
    pairs = [(s, s + n) for s, n in pairs]
    for s, e in pairs:
        total += m.insert(s, e)
    assert list(zip(m.starts, m.ends)) == union(pairs) and total == len(m.starts)
    assert m.gaps() == [(a[1], b[0]) for a, b in zip(union(pairs), union(pairs)[1:])]


def made(seed):
    rnd = random.Random(seed)
    data = []
    for k in ["a", "b", "hot"]:
        for _ in range(30 if k != "hot" else 300):
            s = rnd.randrange(0, 9 * HOUR)
            data.append((k, s, rnd.choice([None, s, s - 5, s + rnd.randrange(1, 400_000), s + rnd.randrange(1, 3 * HOUR)])))
    return data + data[:20] + [(None, 1, 2), ("a", None, 5), ("unknown", 0, 10)]


@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_and_periods_against_brute_force(spark, seed):
    data = made(seed)
    cues = spark.createDataFrame(data, SCHEMA)
    lengths = {"a": 8 * HOUR, "b": None, "hot": 20 * HOUR, "silent": 50, "none": None, "zero": 0}
    known = spark.createDataFrame(list(lengths.items()), "source_id string, duration_ms bigint")
    want_gaps, want_periods = set(), set()
    for k, length in lengths.items():
        periods = union([(s, e) for key, s, e in data if key == k])
        want_periods |= {(k, *p) for p in periods}
        at = 0
        for s, e in periods:
            if s > at:
                want_gaps.add((k, at, s))
            at = max(at, e)
        if length is not None and length > at:
            want_gaps.add((k, at, length))
    assert {tuple(r) for r in intervals.uncovered(cues, known).collect()} == want_gaps
    assert {tuple(r) for r in intervals.spoken_periods(cues, known).collect()} == want_periods


def test_empty_and_extra_columns(spark):
    cues = spark.createDataFrame([], SCHEMA + ", _key string, _cell bigint, _end bigint")
    known = spark.createDataFrame([("a", 10)], "source_id string, duration_ms bigint")
    assert [tuple(r) for r in intervals.uncovered(cues, known).collect()] == [("a", 0, 10)]
    assert intervals.spoken_periods(cues, known).count() == 0
    assert intervals.uncovered(cues, known.where("false")).count() == 0


def test_stream_holds_the_same_periods(spark, tmp_path):
    data = [(k, s, e) for k, s, e in made(5) if k is not None]
    for i in range(3):
        spark.createDataFrame(data[i::3], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    newest = {}

    def keep(batch, _):
        by = {}
        for r in batch.collect():
            by.setdefault((r._key, r._cell), []).append((r._start, r._end))
        newest.update(by)

    stream_periods(stream, "source_id", "start_ms", "end_ms").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    want = {(r._key, r._cell, r._start, r._end) for r in intervals.cell_periods(spark.createDataFrame(data, SCHEMA), "source_id", "start_ms", "end_ms").collect()}
    assert {(*k, *p) for k, ps in newest.items() for p in ps} == want


def test_stream_gives_the_same_gaps(spark, tmp_path):
    data = made(7)
    for i in range(4):
        spark.createDataFrame(data[i::4], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("a", 8 * HOUR), ("b", None), ("hot", 20 * HOUR), ("silent", 50)], "source_id string, duration_ms bigint")
    cells = newest(stream_gaps(stream, "source_id", "start_ms", "end_ms"), "test-gaps")
    want = {tuple(r) for r in intervals.uncovered(spark.createDataFrame(data, SCHEMA), known).collect()}
    assert {tuple(r) for r in intervals.up_to_durations(cells, known).collect()} == want
