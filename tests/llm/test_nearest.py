import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from cuewright.llm import nearest

LEFT, RIGHT = "claim_id bigint, source_id string, t bigint, tol bigint, distance_ms int, _key string", "evidence_id bigint, source_id string, start_ms bigint, _at string"


def brute(left, right):
    out = {}
    for i, k, t, tol, *_ in left:
        if i is None or k is None or t is None:
            continue
        near = [(abs(s - t), s, e) for e, key, s, *_ in right if key == k and s is not None and e is not None]
        if near and min(near)[0] <= (30_000 if tol is None else tol):
            out[i] = min(near)[2]
    return out


def run(spark, left, right):
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    return [(r.claim_id, r.evidence_id) for r in nearest.nearest_in_time(a, b, "source_id", "claim_id", "t", "evidence_id", "start_ms", "tol").collect()]


@pytest.mark.parametrize("span, tolerances", [(400_000, [None, 0, 5, 20_000]), (10**9, [None, 10**7, 10**12, -1]), (50, [1, 2, 3])])
def test_against_brute_force(spark, span, tolerances):
    rnd = random.Random(span)
    at = lambda: rnd.choice([None, rnd.randrange(-span // 4, span)])
    key = lambda: rnd.choice(["a", "b", "hot", "hot", "hot", None])
    right = [(rnd.choice([None, i]) if i % 50 == 0 else i, key(), at(), "x") for i in range(300)]
    left = [(i, key(), at(), rnd.choice(tolerances), 0, "y") for i in range(300)]
    got = run(spark, left + left[:40], right + right[:40])
    assert len(got) == len(dict(got)) and dict(got) == brute(left, right)


def test_nothing(spark):
    some = [(1, "a", 5, None, 0, "y")]
    assert run(spark, [], [(1, "a", 5, "x")]) == [] and run(spark, some, []) == [] and run(spark, some, [(1, "b", 5, "x")]) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9)), max_size=12), st.lists(st.integers(0, 60), max_size=12))
def test_midpoints(spark, claims, times):
    left = [(i, "a", t, tol, 0, "y") for i, (t, tol) in enumerate(claims)]
    right = [(i, "a", t, "x") for i, t in enumerate(times)]
    assert dict(run(spark, left, right)) == brute(left, right)
