import random

import pytest

from cuewright.llm import leakage
from cuewright.llm.leakage import passages, words

DOC, ITEM = "doc_id bigint, text string", "item_id bigint, text string"
VOCABULARY = [f"{a}{b}" for a in "bdfgklmnprstvz" for b in ("ar", "elo", "int", "om", "usk", "yle", "ag", "esh")]


def text(rnd, n):
    return [rnd.choice(VOCABULARY) for _ in range(n)]


def brute(docs, items):
    """Every pair, every hit, with the same rule for passages."""
    out = {}
    for d, t in docs:
        if d is None or t is None:
            continue
        w = words(t)
        where = {}
        for n in (1, 2, 3):
            for k in range(len(w) - n + 1):
                where.setdefault(tuple(w[k : k + n]), []).append(k)
        for i, u in items:
            v = words(u or "")
            if i is None or not v:
                continue
            n = min(3, len(v))
            hits = sorted((k, q) for q in range(len(v) - n + 1) for k in where.get(tuple(v[q : q + n]), ()))
            covered, _ = passages(hits, min(leakage.PASSAGE_WORDS, len(v)), n)
            if len(covered) >= len(v) / 3:
                out[i, d] = max(out.get((i, d), 0), round(len(covered) / len(v), 9))
    return out


def test_against_brute_force_with_planted_passages(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SHARD", 300)
    rnd = random.Random(8)
    items = [(i, " ".join(text(rnd, rnd.choice([4, 12, 30, 60])))) for i in range(40)]
    common = text(rnd, 7)
    docs = []
    for d in range(300):
        body = text(rnd, rnd.randrange(0, 150))
        if rnd.random() < 0.7:
            v = words(rnd.choice(items)[1])
            a = rnd.randrange(0, len(v))
            b = min(len(v), a + rnd.choice([4, 12, 25, 60]))
            part = v[a:b]
            for _ in range(rnd.randrange(0, 3)):
                if len(part) > 8:
                    k = rnd.randrange(len(part))
                    part = rnd.choice([part[:k] + part[k + 1 :], part[:k] + text(rnd, 1) + part[k:], part[:k] + text(rnd, 1) + part[k + 1 :]])
            k = rnd.randrange(len(body) + 1)
            body = body[:k] + part + body[k:]
        docs.append((d, " ".join(body + common * rnd.randrange(0, 3))))
    docs += [(400 + d, items[30][1]) for d in range(200)]  # one item in a third of all documents
    docs += docs[:20] + [(None, items[0][1]), (900, None), (901, ""), (902, items[1][1] + " " + " ".join(text(rnd, 60_000)))]
    items += [(50, " ".join(VOCABULARY[:2])), (53, VOCABULARY[5]), (51, None), (None, "x y z w"), (52, ""), items[3]]
    docs += [(910, "x " + VOCABULARY[0] + ", " + VOCABULARY[1])]
    got = {(r.item_id, r.doc_id): round(r.share, 9) for r in leakage.leaked(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()}
    assert got == brute(docs, items) and len(got) > 250
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 200)
    again = {(r.item_id, r.doc_id): round(r.share, 9) for r in leakage.leaked(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()}
    assert again == got


def test_planted_passages_are_found_and_nothing_else(spark, tmp_path):
    """Independent of the operator's own functions: what was planted is known."""
    rnd = random.Random(21)
    filler = [f"f{k}" for k in range(400)]
    items = [(i, text(rnd, 36)) for i in range(30)]
    docs, want, kinds = [], set(), {}
    for d in range(600):
        body = [rnd.choice(filler) for _ in range(rnd.randrange(20, 200))]
        i, v = rnd.choice(items)
        kind = d % 6
        k = rnd.randrange(len(body))
        if kind == 0:  # a passage as it stands
            a = rnd.randrange(0, 18)
            part = v[a : a + 18]
            kinds[i, d] = "exact"
        elif kind == 1:  # with a changed word in it
            part = [*v[:14], "other", *v[15:30]]
            kinds[i, d] = "proximity"
        elif kind == 2:  # in two places
            body = v[:12] + body
            part = v[20:33]
            kinds[i, d] = "exact"
        elif kind == 3:  # a short quotation
            part = v[:5]
        elif kind == 4:  # the same words in another order
            part = rnd.sample(v, len(v))
        else:
            part = []
        if kind < 3:
            want.add((i, d))
        docs.append((d, " ".join(body[:k] + part + body[k:]).upper()))
    corpus = spark.createDataFrame(docs, DOC).repartition(4)
    leakage.index(corpus).write.parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    rows = leakage.search(stored, spark.createDataFrame([(i, " ".join(v)) for i, v in items], ITEM)).collect()
    assert {(r.item_id, r.doc_id) for r in rows} == want and {(r.item_id, r.doc_id): r.kind for r in rows} == kinds
    words_of = {d: t.lower().split() for d, t in docs}
    for r in rows:
        v = dict(items)[r.item_id]
        for p in r.passages:
            part = words_of[r.doc_id][p.first_word : p.last_word + 1]
            assert part[0] in v and part[-1] in v and len(part) >= 9 and (not p.exact or " ".join(part) in " ".join(v))
    # other items from the same index, without the corpus
    other = " ".join(words_of[5][:20])
    assert {r.doc_id for r in leakage.search(stored, spark.createDataFrame([(99, other)], ITEM)).collect()} >= {5}


SENTENCE = "The careful magnets have to slow the façades until these anchors keep the northern lanterns over seven quiet winters"


@pytest.mark.parametrize(
    "shape",
    [
        str.upper, lambda t: t.replace(" ", "\n"), lambda t: "<p>" + t.replace(" the ", "&nbsp;the&nbsp;") + "</p>", lambda t: t.replace("magnets", "mag­nets").replace("ç", "c"), lambda t: t.replace(" ", ", "), lambda t: t.replace("lanterns", "lan-\nterns"),
        lambda t: "“" + t + "”", lambda t: t.replace("northern", "southern"), lambda t: t.replace("careful ", ""), lambda t: t.replace(" over", " very much over"), lambda t: "​".join(t.split("quiet")).replace("​", "quiet​"),
    ],
)
def test_surface(shape):
    v, w = words(SENTENCE), words(shape(SENTENCE))
    hits = sorted((k, q) for q in range(len(v) - 2) for k in range(len(w) - 2) if v[q : q + 3] == w[k : k + 3])
    assert len(passages(hits, 9)[0]) >= len(v) / 2


def test_mere_reuse_of_words_is_no_case(spark):
    shuffled = SENTENCE.split()
    random.Random(1).shuffle(shuffled)
    docs = [(1, " ".join(shuffled)), (2, "The careful magnets have to slow down"), (3, "x " + SENTENCE)]
    got = leakage.leaked(spark.createDataFrame(docs, DOC), spark.createDataFrame([(7, SENTENCE)], ITEM)).collect()
    assert [(r.item_id, r.doc_id) for r in got] == [(7, 3)]


def test_empty(spark):
    some = spark.createDataFrame([(1, SENTENCE)], DOC)
    assert leakage.leaked(some, spark.createDataFrame([], ITEM)).count() == 0
    assert leakage.leaked(some.where("false"), spark.createDataFrame([(7, SENTENCE)], ITEM)).count() == 0
    assert leakage.leaked(some, spark.createDataFrame([(7, "entirely different words than those")], ITEM)).count() == 0
