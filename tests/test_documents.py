import random
from datetime import datetime

from pyspark.sql import functions as F

from cuewright.operators import documents as docs, scoring, synthesis
from cuewright.plans import document_queries

EVIDENCE = "evidence_id bigint, source_id string, topic_id string, claim_no int, text string, start_ms bigint, end_ms bigint, provenance string"


def test_packs_and_digest(spark):
    rows = [(2, "s", "c-topic-001", 2, "second", None, None, "ai_explanation"), (1, "s", "c-topic-001", 1, "first", 65_000, 70_000, "source"), (3, "s", "c-topic-002", 1, "lost", None, None, "source"), (4, None, "c-topic-001", 1, "x", 1, 2, "source"), (5, "s", None, 1, "x", 1, 2, "source")]
    packs = synthesis.topic_packs(spark.createDataFrame(rows, EVIDENCE))
    assert [(r.topic_id, [c.text for c in r.claims]) for r in packs.collect()] == [("c-topic-001", ["first", "second"])]
    chapters = spark.createDataFrame([("s", "c", "Intro")], "source_id string, chapter_id string, title string")
    assert docs.digests(packs, chapters).first().document == "## Intro\n\n### c-topic-001\n\n- [Source] first (01:05)\n- [AI Explanation] second\n"
    again = synthesis.topic_packs(spark.createDataFrame(rows[::-1], EVIDENCE))
    assert again.first().fingerprint == packs.first().fingerprint
    titles = spark.createDataFrame([("s", "T")], "source_id string, title string")
    assert synthesis.source_packs(packs, titles).first().topics == 1


def test_vault(spark):
    notes = spark.createDataFrame([("s", "a", "x/y", "one"), ("s", "b", "x:y", "two"), ("s", "c", None, None)], "source_id string, topic_id string, title string, summary string")
    urls = spark.createDataFrame([("s", "http://u")], "source_id string, canonical_url string")
    got = {r.path: r.content for r in docs.vault(notes, urls).collect()}
    assert set(got) == {"x-y.md", "x-y-b.md", "note.md"} and got["x-y-b.md"] == "---\nsource: http://u\ntopic_id: b\n---\n\n# x:y\n\ntwo\n"
    assert [r.line for r in docs.vault_index(notes).orderBy("topic_id").collect()] == ["- [[x-y]]", "- [[x-y-b]]", "- [[note]]"]


def test_cache_never_leaves_its_folder(spark):
    wanted = spark.createDataFrame([("k",), ("bad",), ("up",), ("new",)], "cache_key string")
    cache = spark.createDataFrame([("k", "a/b.md", "d"), ("bad", "/etc/x", "d"), ("up", "a/../../x", "d")], "cache_key string, path string, document string")
    hit, miss = docs.cached(wanted, cache)
    assert [r.cache_key for r in hit.collect()] == ["k"] and {r.cache_key for r in miss.collect()} == {"bad", "up", "new"}


def test_json(spark):
    assert docs.as_json(spark.createDataFrame([("s", None)], "source_id string, a string"), "source_id", pretty=False).first().document == '{"a":null,"source_id":"s"}'


def test_generation_repairs_once(spark):
    def flaky(text, complaint):
        if text == "never":
            raise RuntimeError("no")
        return {"summary": "ok", "concepts": []} if complaint or text == "good" else {"summary": ""}

    df = spark.createDataFrame([(1, "good"), (2, "once"), (3, "never"), (4, None)], "id int, text string")
    got = {r.id: (r.summary, r.attempts, r.error) for r in synthesis.generated(df, ["id"], "text", flaky).collect()}
    assert got == {1: ("ok", 1, None), 2: ("ok", 2, None), 3: (None, 2, "RuntimeError: no"), 4: ("ok", 2, None)}
    assert synthesis.extractive("The looms weave. They weave looms daily.")["concepts"][:2] == ["looms", "weave"]


def test_first_sentence_is_whole():
    words = " ".join(f"loom{k}" for k in range(200))
    assert synthesis.extractive(f"{words}. Next.")["summary"] == words + "." and synthesis.extractive(words)["summary"] == words


def test_overview_repair(spark):
    df = spark.createDataFrame([('```json\n{"overview":"","summary":"S"}\n```',), ('{"text":"T"}',), ("nonsense",)], "a string")
    assert [r[0] for r in df.select(synthesis.repaired_overview(F.col("a"))).collect()] == ["S", "T", None]


def test_scores(spark):
    claims = spark.createDataFrame([("s", 1, "the looms weave cloth", "they weave", 120_000, 30_000), ("s", 2, "nothing like it", "e", 400_000, 30_000)], "source_id string, claim_id bigint, text string, evidence string, timestamp_ms bigint, tolerance_ms bigint")
    points = spark.createDataFrame([("s", 10, "the looms weave cloths", 200_000), ("s", 11, "the looms weave", 121_000), ("s", 12, "zzz", 400_000), ("t", 13, "the looms weave cloth", 120_000)], "source_id string, point_id bigint, text string, timestamp_ms bigint")
    matches = scoring.matched(scoring.candidate_pairs(claims, points))
    assert [(r.claim_id, r.point_id) for r in matches.collect()] == [(1, 10)]
    r = scoring.scores(claims, matches, spark.createDataFrame([("s", 600_000)], "source_id string, duration_ms bigint")).first()
    assert (r.claims, r.matched, r.recall, r.timestamp_accuracy, r.quarters) == (2, 1, 0.5, 0.0, 0.25)
    assert scoring.similarity("A  b", "a b") == 1.0 and scoring.similarity("", "a") == 0.0 and scoring.similarity(None, "a") == 0.0


def test_scores_compare_a_whole_source(spark, monkeypatch):
    """As all pairs of a source compared one by one, claims choosing in order, however far apart in time."""
    monkeypatch.setattr(scoring, "TILE", (7, 11))
    r = random.Random(5)
    words = "the looms weave cloth near old mills while barges carry grain 베틀이 천을 짭니다".split()
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 9)))
    said = [text() for _ in range(60)]
    claims = [("st"[k % 2], k, r.choice(said), text(), k * 90_000, 30_000) for k in range(40)] + [("s", 40, "", "e", 0, 1), ("s", 41, None, None, 0, 1), ("s", 42, "a" * 1500, "", 0, 1)]
    points = [("st"[k % 2], 100 + k, t, r.randrange(9_000_000)) for k, t in enumerate(said)] + [("s", 200, None, 0), ("s", 201, "a" * 1400 + "b" * 90, 7_000_000)]
    want = []
    for source in "st":
        free = [p for p in points if p[0] == source]
        for c in (c for c in claims if c[0] == source):
            best = max(free, key=lambda p: scoring.similarity(p[2], c[2]))
            if scoring.similarity(best[2], c[2]) >= scoring.STATES:
                free.remove(best)
                want.append((c[1], best[1], scoring.similarity(best[2], c[2]), abs(c[4] - best[3])))
    made = scoring.matched(scoring.candidate_pairs(spark.createDataFrame(claims, "source_id string, claim_id bigint, text string, evidence string, timestamp_ms bigint, tolerance_ms bigint"), spark.createDataFrame(points, "source_id string, point_id bigint, text string, timestamp_ms bigint")))
    assert sorted((x.claim_id, x.point_id, x.score, x.distance_ms) for x in made.collect()) == sorted(want)
    assert len(want) > 20 and max(w[3] for w in want) > 1_000_000


def test_claims_ask_again_until_no_point_is_left(spark, monkeypatch):
    """Crowded points: the same choice as from all pairs, though each claim asks for its best point only at first."""
    monkeypatch.setattr(scoring, "FIRST", 1)
    monkeypatch.setattr(scoring, "TILE", (7, 2048))
    r = random.Random(8)
    words = "the looms weave cloth near old mills while barges carry grain".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    claims = [(s, k, "the looms weave cloth " + text(k % 3), text(2), k * 1000, 30_000) for k in range(36) for s in "st"[k % 2 :][:1]]
    points = [("st"[k % 2], 100 + k, "the looms weave cloth " + text(k % 4), 5_000 if k % 5 else None) for k in range(30)] + [("s", 150 + k, text(6), 1) for k in range(10)]
    claims, points = spark.createDataFrame(claims, "source_id string, claim_id bigint, text string, evidence string, timestamp_ms bigint, tolerance_ms bigint"), spark.createDataFrame(points, "source_id string, point_id bigint, text string, timestamp_ms bigint")
    want = sorted(map(tuple, scoring.matched(scoring.candidate_pairs(claims, points)).collect()), key=lambda x: x[1])
    assert sorted(map(tuple, scoring.best_matches(claims, points).collect()), key=lambda x: x[1]) == want and 20 < len(want) < 36


def test_few_texts_are_compared_in_full(monkeypatch):
    """A claim's best points of thousands are found by comparing some; bounds are those of common subsequences."""
    r = random.Random(3)
    words = ["".join(r.choice("etaoinshrdlué베") for _ in range(r.randint(2, 8))) for _ in range(200)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 20))) for _ in range(1500)] + ["\U0001f600" * 300]
    tile, claim = scoring.Tile(texts), " ".join(r.choice(words) for _ in range(9))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    got = tile.common(claim)
    assert all(got[k] == common(claim, texts[k]) for k in [*range(0, 1500, 25), 1500])
    compared, ratio = [], scoring.SequenceMatcher.ratio
    monkeypatch.setattr(scoring.SequenceMatcher, "ratio", lambda self: compared.append(1) or ratio(self))
    one = scoring.Claim(1, claim, 0.3, 3)
    one.compare(tile, list(range(1501)))
    n = len(compared)
    assert [p for _, p in one.best] == sorted(range(1501), key=lambda k: (-scoring.similarity(texts[k], claim), k))[:3] and n < 150
    again, before = scoring.Claim(1, claim, 0.3, 3), len(compared)
    again.compare(scoring.Tile(texts * 5), list(range(5 * 1501)))
    assert [p for _, p in again.best] == [one.best[0][1] + 1501 * k for k in range(3)]
    assert len(compared) - before <= n  # equal texts are compared once


def test_scores_without_times(spark, tmp_path):
    """Claims and points without a time count and match; a point's own evidence is compared where there is one."""
    claim, point = "source_id string, claim_id bigint, text string, evidence string, timestamp_ms bigint, tolerance_ms bigint", "source_id string, point_id bigint, text string, timestamp_ms bigint, evidence string"
    claims = spark.createDataFrame([("s", 1, "the looms weave cloth", "they weave", None, 30_000), ("s", 2, "mills grind grain", "they grind", 5, 30_000), ("s", 3, "barges", "b", None, 9)], claim)
    points = spark.createDataFrame([("s", 10, "the looms weave cloth", 0, "they weave"), ("s", 11, "mills grind grain", None, "zzz")], point)
    lengths = spark.createDataFrame([("s", 100)], "source_id string, duration_ms bigint")
    r = scoring.scores(claims, scoring.matched(scoring.candidate_pairs(claims, points)), lengths).first()
    assert (r.claims, r.matched, round(3 * r.evidence_coverage), r.timestamp_accuracy, r.quarters) == (3, 2, 1, 0.0, 0.25)
    evidence = [(11, "s", "c-topic-001", 1, "mills grind grain", None, None, "source")]
    spark.createDataFrame(evidence, EVIDENCE).write.parquet(f"{tmp_path}/evidence.parquet")
    claims.write.parquet(f"{tmp_path}/reference_claims.parquet")
    spark.createDataFrame([("s", 100, datetime(2025, 1, 1))], "source_id string, duration_ms bigint, ingested_at timestamp").write.parquet(f"{tmp_path}/transcripts.parquet")
    r = document_queries.claim_scores(spark, str(tmp_path)).first()
    assert (r.claims, r.matched) == (3, 1)


def test_three_passes(spark):
    def stop(text, complaint):
        raise ValueError("no") if "bad" in text else None

    def mark(text, complaint):
        if "bad" in text:
            raise ValueError("no")
        return {"summary": text + "!", "concepts": []}

    df = spark.createDataFrame([(1, "One. Two."), (2, "bad")], "id int, text string")
    got = {r.id: (r.document, r.error) for r in synthesis.composed(df, ["id"], "text", mark, mark, mark).collect()}
    assert got[1][0].count("!") == 3 and got[2] == (None, "ValueError: no")


def test_last_message(spark):
    lines = '{"type":"x","item":{"type":"agent_message","text":"one"}}\nnoise\n{"usage":{"in":1}}\n{"item":{"type":"agent_message","text":"two"}}\n{"usage":{"in":2,"out":3}}'
    df = spark.createDataFrame([(lines,), ("",), (None,)], "l string").select(synthesis.last_message(F.col("l")).alias("m"))
    assert [(r.m.text, r.m.usage) for r in df.collect()] == [("two", {"in": 2, "out": 3}), (None, None), (None, None)]
