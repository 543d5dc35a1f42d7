import random

import pytest

from cuewright.llm import truncation
from cuewright.llm.truncation import ending

DOC = "doc_id bigint, source string, text string, state string, reason string"


@pytest.mark.parametrize(
    "text, state",
    [
        ("All is said.", "ended"), ("Is it?", "ended"), ('He said "so."', "ended"), ("終わりです。", "ended"), ("", "empty"), (" \n ", "empty"), ("the wor�", "cut"), ("bread &am", "cut"), ("bread &#4", "cut"), ("see [[Loo", "cut"), ("- [12:0", "cut"), ("a <b", "cut"), ("1. one\n2.", "cut"),
        ("R&D", "open"), ("over the hil", "open"), ("over the...", "dots"), ("over the…", "dots"), ("All is said.\n\nhttps://a.example/p/1", "ended"), ("All is said.\n\n#notes #looms", "ended"), ("All is said.\n— the editors", "ended"), ("All is said.\n[43:08]", "ended"), ("All is said.\n♪ music ♪", "ended"),
        ("All is said.\n- and one more", "open"),
    ],
)
def test_endings(text, state):
    assert ending(text)[0] == state


@pytest.mark.parametrize("text", ["x" * 300_000, "#a " * 50_000 + "x", "(" * 100_000, "\n" * 100_000 + "a", "[" * 100_000, "♪ " * 50_000, "a. " * 50_000 + "b\n#c", "<a" * 50_000])
def test_endings_of_very_long_texts_take_no_time(text):
    import time

    start = time.perf_counter()
    ending(text)
    truncation._sentence_like(text)
    assert time.perf_counter() - start < 2


NOUNS, VERBS, ADJECTIVES = ["looms", "harbors", "lanterns", "furnaces", "meadows", "kilns"], ["surround", "protect", "measure", "strengthen"], ["northern", "stubborn", "granular", "portable"]


def sentence(rnd):
    return f"The {rnd.choice(ADJECTIVES)} {rnd.choice(NOUNS)} {rnd.choice(VERBS)} these {rnd.choice(ADJECTIVES)} {rnd.choice(NOUNS)}."


def test_planted_cuts(spark):
    rnd = random.Random(6)
    rows, cut = [], set()
    for d in range(400):
        body = " ".join(sentence(rnd) for _ in range(rnd.randrange(2, 9)))
        kind = d % 10
        if kind == 0:
            rows.append((d, "plain", body[: body.rstrip(".").rfind(" ") + 4]))  # within the last word
            cut.add(d)
        elif kind == 1:
            rows.append((d, "plain", body[: body.rfind(" these ") + 6]))  # after a word that ends nothing
            cut.add(d)
        elif kind == 2:
            rows.append((d, "dots", body[: body.rfind(" these ") + 10] + "..."))
            cut.add(d)
        elif kind == 3:
            rows.append((d, "plain", "\n".join("- " + s.rstrip(".") for s in body.split(". ") if s)))  # a list without marks
        elif kind == 4:
            rows.append((d, "plain", body + " To be continued..."))
        elif kind == 5:
            rows.append((d, "plain", body + "\n\n— night shift"))
        elif kind == 6:
            rows.append((d, "plain", body[: body.rfind(" ") + 2] + "�"))
            cut.add(d)
        else:
            rows.append((d, "plain", body))
    rows += [(1000, "plain", None), (1001, "plain", ""), (None, "plain", "the loo"), (1002, None, "The looms protect the northern " * 3000 + "ki")]
    cut.add(1002)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DOC)
    got = {r.doc_id: r.reason for r in truncation.judged(df).collect()}
    assert {d for d, reason in got.items() if reason} == cut
    assert 1000 not in got and 1001 in got
    share = {r.source: (r.documents, r.truncated) for r in truncation.truncated_share(df).collect()}
    assert share["dots"] == (40, 40) and share[None] == (1, 1)


def test_longer_copies(spark):
    rnd = random.Random(9)
    whole = [" ".join(sentence(rnd) for _ in range(5)) for _ in range(60)] + ["# Weekly digest of the northern harbors\n\n" + " ".join(sentence(rnd) for _ in range(k % 7)) + f" more {k}" for k in range(80)]
    docs = [(i, w) for i, w in enumerate(whole)] + [(1000 + i, w[: rnd.randrange(2, len(w) - 1)]) for i, w in enumerate(whole)] + [(2000 + i, w) for i, w in enumerate(whole[:10])]
    docs += [(3000 + i, w[: rnd.randrange(40, len(w) - 1)] + "...") for i, w in enumerate(whole[:20])] + [(4000, ""), (4001, "x" * 5000), (4002, "x" * 9000), (4003, "x" * 5000)]
    texts = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    ends = truncation._with_base(spark.createDataFrame([(d, ending(t)[0], t) for d, t in docs], "doc_id bigint, state string, text string")).drop("text")
    got = {r.doc_id for r in truncation._has_longer_copy(texts, ends).collect()}
    base = {d: t.rstrip(" \n.…") for d, t in docs}

    def goes_on(t):  # what follows it, where it is short, has to be the same everywhere
        on = {u[len(t) : len(t) + truncation.GOES_ON] for u in docs_ if len(u.rstrip(" \n.…")) > len(t) and u.startswith(t)}
        return bool(on) if len(t) >= truncation.HEAD else len(on) == 1

    docs_ = [t for _, t in docs]
    assert got == {d for d, t in docs if ending(t)[0] in ("open", "dots") and base[d] and goes_on(base[d])} and len(got) > 80 and {4001, 4003} <= got


def test_pieces_of_long_words(spark):
    counts = spark.createDataFrame([("a" * 60, 3), ("a" * 50 + "b", 2), ("looms", 5), ("loo", 1)], "key string, total bigint")
    wanted = spark.createDataFrame([("a" * 50,), ("a" * 60,), ("loo",), ("looms",)], "key string")
    assert {(r.key, r.longer) for r in truncation._longer_words(wanted, counts).collect()} == {("a" * 50, 5), ("loo", 5)}


def test_typos_of_a_large_corpus_do_not_hide_pieces(spark):
    rnd = random.Random(12)
    body = " ".join(sentence(rnd) for _ in range(400))
    rows = [(k, "s", body + " The loo is a typo here. " + body, "", "") for k in range(3)] + [(100, "s", " ".join(sentence(rnd) for _ in range(3)) + " The northern meado", "", ""), (101, "s", "The northern kilns protect these loo", "", "")]
    got = {r.doc_id for r in truncation.judged(spark.createDataFrame(rows, DOC)).where("truncated").collect()}
    assert got == {100, 101}


def test_long_trailers_and_words():
    links = "\n".join(f"https://a.example/{'p' * 90}/{k}" for k in range(40))
    assert ending("All is said.\n\n" + links)[0] == "ended" and ending("All is sai\n\n" + links)[1] == "sai" and ending("so " + "ab" * 400)[1] == "ab" * 400


def test_a_field_limit(spark):
    rnd = random.Random(10)
    rows = []
    for d in range(40):
        body = " ".join(sentence(rnd) for _ in range(12))
        rows.append((d, "short", body[:300]))
    lists = [(100 + d, "short", "\n".join("- " + sentence(rnd).rstrip(".") for _ in range(14))[:300]) for d in range(6)]
    other = [(200 + d, "long", "\n".join("- " + sentence(rnd).rstrip(".") for _ in range(4))) for d in range(40)]
    got = {r.doc_id: r.truncated for r in truncation.judged(spark.createDataFrame([(*r, "x", "y") for r in rows + lists + other], DOC)).collect()}
    assert all(got[100 + d] for d in range(6)) and not any(got[200 + d] for d in range(40))


def test_empty(spark):
    df = spark.createDataFrame([], DOC)
    assert truncation.judged(df).count() == 0 and truncation.truncated_share(df).count() == 0
