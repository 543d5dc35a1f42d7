import random

from pyspark.sql import functions as F

from cuewright.operators import packs, scoring, synthesis

CLAIM = "source_id string, topic_id string, claim_no int, evidence_id bigint, text string, start_ms bigint, end_ms bigint, provenance string, chapter_id string"


def topics(spark):
    rows = [
        ("s", "c1-topic-001", 1, 1, "One is said. More.", 61_000, 62_000, "source", "x"), ("s", "c1-topic-001", 2, 2, "Two", None, None, "ai_explanation", "x"), ("s", "c1-topic-002", None, 3, "Three!", 3_700_000, 3_700_001, "source", "x"),
        ("s", "c2-topic-001", 1, 4, "Four", None, None, "source", "x"), ("s", "c3-topic-001", 1, 5, "Five.", 1, 2, "source", "x"), (None, "c1-topic-001", 1, 6, "x", 1, 2, "source", "x"), ("s", None, 1, 7, "x", 1, 2, "source", "x"),
    ]
    return packs.summarized_topics(synthesis.topic_packs(spark.createDataFrame(rows, CLAIM)))


def test_a_pack_and_its_documents(spark):
    chapters = packs.chapter_packs(topics(spark), spark.createDataFrame([("s", "c1", "First"), ("s", "c3", "  "), ("other", "c1", "No")], "source_id string, chapter_id string, title string"))
    by = {r.chapter_id: r for r in chapters.collect()}
    assert set(by) == {"c1", "c3"}  # a claim from the source without a time is none
    assert (by["c1"].title, by["c1"].summary, by["c1"].topic_ids) == ("First", "One is said.", ["c1-topic-001", "c1-topic-002"]) and by["c3"].title == "c3"
    whole = packs.knowledge_packs(chapters, spark.createDataFrame([("s", "T", "en", "f")], "source_id string, title string, language string, transcript_fingerprint string"))
    one = whole.first()
    assert (one.title, one.overview, one.chapters, one.topics) == ("T", "One is said.", 2, 3)
    parts = packs.digest_parts(whole, chapters).orderBy("part").collect()
    assert "".join(p.document for p in parts) == (
        "# T\n\nOne is said.\n\n## First\n\nOne is said.\n\n### c1-topic-001\n\nOne is said. More.\n\n- [Source] One is said. More. (01:01)\n- [AI Explanation] Two\n\n### c1-topic-002\n\nThree!\n\n- [Source] Three! (01:01:40)\n"
        "\n## c3\n\nFive.\n\n### c3-topic-001\n\nFive.\n\n- [Source] Five. (00:00)\n"
    )
    same = topics(spark).withColumn("title", F.lit("a/b"))
    files = packs.vault_files(whole, same, spark.createDataFrame([("s", "https://x")], "source_id string, canonical_url string")).collect()
    assert {f.path for f in files} == {"a-b.md", "a-b-c1-topic-002.md", "a-b-c3-topic-001.md", "index.md"}
    index = "".join(f.content for f in sorted(files, key=lambda f: f.part) if f.path == "index.md")
    assert index == "---\nsource: https://x\n---\n\n# T\n\nOne is said.\n\n## Topics\n\n- [[a-b]]\n- [[a-b-c1-topic-002]]\n- [[a-b-c3-topic-001]]\n"


def test_nothing_gives_nothing(spark):
    none = topics(spark).where("false")
    chapters = packs.chapter_packs(none, spark.createDataFrame([], "source_id string, chapter_id string, title string"))
    assert chapters.count() == 0
    assert packs.knowledge_packs(chapters, spark.createDataFrame([], "source_id string, title string, language string, transcript_fingerprint string")).count() == 0


def test_many_texts_are_reduced_in_rounds(spark):
    rnd = random.Random(4)
    rows = [("k", i, f"t{i}") for i in range(500)] + [("few", 1, None), ("few", 0, "a")]
    seen = []

    def longest(text, complaint):
        return {"summary": str(sum(int(w.lstrip("t")) for w in text.split())) if text.strip("a ") else "a", "concepts": [str(len(text.split()))]}

    rnd.shuffle(rows)
    got = {r.k: r.summary for r in packs.reduced(spark.createDataFrame(rows, "k string, i int, t string"), ["k"], "i", "t", longest, fan=8).collect()}
    assert got == {"k": str(sum(range(500))), "few": "a"} and not seen


def test_unsupported_points_structure_and_report(spark):
    claims = spark.createDataFrame([("s", 1, "the looms weave", "e", 10, 30_000), ("t", 2, "nothing alike", "e", None, 1)], "source_id string, claim_id bigint, text string, evidence string, timestamp_ms bigint, tolerance_ms bigint")
    points = spark.createDataFrame([("s", 1, "the looms weave", 10), ("s", 2, "quite different", None)], "source_id string, point_id bigint, text string, timestamp_ms bigint")
    matches = scoring.matched(scoring.candidate_pairs(claims, points))
    made = scoring.scores(claims, matches, spark.createDataFrame([("s", 100)], "source_id string, duration_ms bigint"), points, spark.createDataFrame([("s", "x"), ("t", "y")], "source_id string, overview string"))
    rows = {r.source_id: r for r in made.collect()}
    assert (rows["s"].matched, rows["s"].unsupported, rows["s"].structure) == (1, 1, 1.0) and (rows["t"].matched, rows["t"].unsupported, rows["t"].structure) == (0, 0, 0.0)
    assert {r.line for r in scoring.report(made.where("source_id = 't'")).collect()} == {"| t | 1 | 0 | 0.000 | 0.000 | 0.000 | 0.000 | 0 | 0.000 |"}
