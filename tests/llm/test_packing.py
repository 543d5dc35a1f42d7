import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cuewright.llm import packing

KINDS = "container_name string, capacity_tokens int"


def test_packing_keeps_everything_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 150)
    rnd = random.Random(5)
    items = [(i, rnd.choice([rnd.randrange(1, 60), rnd.randrange(1, 400), 100, 0])) for i in range(2000)] + [(None, 5), (5000, 10_000), (5001, 1)]
    sizes = spark.createDataFrame(items, "doc_id bigint, tokens bigint")
    kinds = spark.createDataFrame([("a", 100), ("b", 1000), ("b", 900), ("bad", 0), ("worse", None), (None, 5)], KINDS)
    rows = packing.pack(sizes, kinds).collect()
    for name, capacity in (("a", 100), ("b", 1000)):
        mine = [r for r in rows if r.container_name == name]
        fill, docs = {}, {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
            docs.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.tokens))
        assert max(fill.values()) <= capacity
        want = {d: n for d, n in items if d is not None and n > 0}
        assert set(docs) == set(want)
        for d, pieces in docs.items():
            at = 0
            for k, (piece, first, n) in enumerate(sorted(pieces)):
                assert (piece, first) == (k, at)
                at += n
            assert at == want[d] and len(pieces) == -(-want[d] // capacity)
        assert sum(fill.values()) / (len(fill) * capacity) > 0.93
    assert {r.container_name for r in rows} == {"a", "b"}
    assert {r.container_name: r.tokens for r in packing.fill(packing.pack(sizes, kinds), kinds).collect()}["a"] == sum(n for d, n in items if d is not None)


def test_nothing_to_pack(spark):
    sizes = spark.createDataFrame([], "doc_id bigint, tokens bigint")
    assert packing.pack(sizes, spark.createDataFrame([("a", 5)], KINDS)).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 5)], "doc_id bigint, tokens bigint"), spark.createDataFrame([], KINDS)).count() == 0


def test_best_fit_with_bounded_space():
    p = packing.Packer(10, open_=2)
    assert [p.place(n) for n in (6, 7, 3, 4, 9, 5)] == [0, 1, 1, 0, 2, 3]
    assert p.left_open == {2, 3}


@pytest.mark.skipif(not Path(packing.TOKENIZER).exists(), reason="no tokenizer")
def test_tokens(spark):
    df = spark.createDataFrame([(1, "The looms weave cloth."), (2, ""), (3, None), (4, "織機 " * 5000), (None, "x")], "doc_id bigint, text string").withColumn("tokens", F.lit("x"))
    got = {r.doc_id: r.tokens for r in packing.token_counts(df).collect()}
    assert set(got) == {1, 2, 4} and got[2] == 0 and 4 <= got[1] <= 8 and got[4] >= 5000


def test_the_last_merge_does_not_grow_with_the_items(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 40)
    monkeypatch.setattr(packing, "FAN", 4)
    rnd = random.Random(8)
    kinds = spark.createDataFrame([("a", 1000)], KINDS)
    seen = []
    whole = packing._merge
    for n in (600, 6000):
        sizes = spark.createDataFrame([(i, rnd.randrange(550, 900)) for i in range(n)], "doc_id bigint, tokens bigint")  # no two fit one container
        most = {}

        def rounds(left, parts, most=most):
            out = []
            for k, m in enumerate(whole_rounds(left, parts)):
                most[k] = max(r[0] for r in m.groupBy("container_name", "to_part").count().select("count").collect())
                out.append(m)
            return out

        whole_rounds = packing._rounds
        monkeypatch.setattr(packing, "_rounds", rounds)
        rows = packing.pack(sizes, kinds).collect()
        monkeypatch.setattr(packing, "_rounds", whole_rounds)
        assert len(rows) == n == len({r.container_id for r in rows}) and whole is packing._merge
        seen.append(max(most.values()))
    assert max(seen) <= packing.FAN * packing.OPEN


def test_more_kinds_than_a_task_fills(spark, monkeypatch):
    monkeypatch.setattr(packing, "KINDS", 2)
    sizes = spark.createDataFrame([(i, i % 7 + 1) for i in range(50)], "doc_id bigint, tokens bigint")
    kinds = spark.createDataFrame([(f"k{c}", c) for c in range(3, 12)], KINDS)
    packed = packing.pack(sizes, kinds)
    assert {(r.container_name, r.documents, r.over, r.lost, r.divided) for r in packing.checked(packed, sizes, kinds).collect()} == {(f"k{c}", 50, 0, 0, 0) for c in range(3, 12)}
    broken = packed.where("doc_id <> 3").unionByName(packed.where("doc_id = 4 AND container_name = 'k3'"))
    assert any(r.lost for r in packing.checked(broken, sizes, kinds).collect())
