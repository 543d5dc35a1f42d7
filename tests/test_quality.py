import random

from pyspark.sql import functions as F

from cuewright.operators import quality

SCHEMA = "source_id string, seg_idx int, start_ms bigint, end_ms bigint, text string, speaker string"
HOUR = 3_600_000


def sequential(cues):
    out = []
    for i, s, e, t, p in sorted(((i, s, e, " ".join((t or "").split()), p) for i, s, e, t, p in cues), key=lambda c: (c[1], c[2], c[0])):
        if not t:
            continue
        if out and out[-1][3] == t and s <= out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([i, s, e, t, p])
    return [tuple(x) for x in out]


def test_normalization_equals_the_sequential_rule(spark):
    rnd = random.Random(4)
    data = []
    for k in range(60):
        span = rnd.choice([20_000, 4 * HOUR])
        for i in range(rnd.randrange(1, 25)):
            s = rnd.randrange(0, span)
            data.append((f"s{k}", i, s, s + rnd.choice([1, span // 6, span]), rnd.choice(["a", " a", "b  b", "b b", "", None]), rnd.choice([None, "x", "y"])))
    got = {}
    for r in quality.normalized(spark.createDataFrame(data, SCHEMA)).collect():
        got.setdefault(r.source_id, []).append((r.seg_idx, r.start_ms, r.end_ms, r.text, r.speaker))
    want = {}
    for s, *cue in data:
        want.setdefault(s, []).append(tuple(cue))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(w) for k, v in want.items() if (w := sequential(v))}


def reports(spark, cues, duration):
    df = spark.createDataFrame([("s", i, *c, None) for i, c in enumerate(cues)], SCHEMA)
    length = spark.createDataFrame([("s", duration)], "source_id string, duration_ms bigint")
    return quality.report(df, length).first()


def test_checks(spark):
    assert reports(spark, [(0, 1000, "hi")], 10_000).reasons == ["coverage"]
    assert "large_gap" in reports(spark, [(180_000, 600_000, "x")], 600_000).reasons
    assert "large_gap" in reports(spark, [(0, 420_000, "x")], 600_000).reasons
    r = reports(spark, [(0, 500, "a"), (400, 900, "b"), (300, 1000, "c")], 1000)
    assert r.reasons == ["timestamps_not_monotonic"] and r.coverage == 1.0 and not r.accepted
    assert reports(spark, [(k * 100, k * 100 + 100, "Same" if k < 4 else "other") for k in range(5)], 500).reasons == ["excessive_repetition"]
    assert reports(spark, [(0, 1000, "  ")], 1000).reasons == ["empty_text"]
    assert reports(spark, [(0, 1000, "fine")], 1000).accepted


CANDIDATE = "source_id string, rank int, provider string, language string, title string, chapters array<string>"


def test_fallback_takes_the_first_acceptable_and_carries_title_and_chapters(spark):
    data = [("s", 1, "auto", None, "T", []), ("s", 2, "api", "fr", "", ["x"]), ("s", 3, "manual", "en-GB", None, None), ("s", 4, "late", "en", "U", ["y"]), ("t", 1, "auto", None, None, None)]
    rows = spark.createDataFrame(data, CANDIDATE)
    got = {r.source_id: r for r in quality.resolved(rows, "de").collect()}
    assert (got["s"].provider, got["s"].title, got["s"].chapters, [(a.provider, a.reasons) for a in got["s"].attempts]) == ("manual", "T", ["x"], [("auto", ["not_available"]), ("api", ["language_mismatch"])])
    assert got["t"].provider is None and [a.reasons for a in got["t"].attempts] == [["not_available"]]
    checks = spark.createDataFrame([("s", 3, False, ["coverage", "large_gap"]), ("s", 4, False, [])], "source_id string, rank int, disordered boolean, reasons array<string>")
    late = quality.resolved(rows, "de", checks).where("source_id = 's'").first()
    assert (late.provider, late.title, late.chapters, late.attempts[-1].reasons) == ("late", "U", ["y"], ["coverage", "large_gap"])
    disordered = checks.select("source_id", F.lit(True).alias("disordered"), "reasons").limit(1)
    none = quality.resolved(rows.drop("chapters"), "de", disordered).where("source_id = 's'").first()
    assert none.provider is None and none.attempts[-1].reasons == ["timestamps_not_monotonic"] and quality.resolved(rows.where("false"), "de", checks).count() == 0


def test_providers_serve_a_kind_of_source(spark):
    rows = [("v", "a", "remote", False), ("v", "b", "local", False), ("v", "c", "remote", True), ("m", "a", "remote", False), ("m", "b", "local", True), ("x", "a", "remote", None), (None, "a", "remote", False)]
    offered = spark.createDataFrame(rows, "source_id string, provider string, scope string, optional boolean")
    sources = spark.createDataFrame([("v", "youtube"), ("m", "local_media"), ("m", "local_media"), (None, "youtube")], "source_id string, kind string")
    pick = lambda more: {(r.source_id, r.provider) for r in quality.offered(offered, sources, more).collect()}
    assert pick(False) == {("v", "a"), ("m", "b"), ("x", "a"), (None, "a")} and pick(True) == pick(False) | {("v", "c")}


def test_usable_cues(spark):
    data = [("s", 1, 0, 10, "b", None), ("s", 1, 0, 10, "a", None), ("s", 2, 5, 5, "x", None), ("s", None, 0, 9, "x", None), (None, 1, 0, 9, "x", None), ("u", 1, 0, 9, "x", None)]
    known = spark.createDataFrame([("s",)], "source_id string")
    assert [tuple(r) for r in quality.usable_cues(spark.createDataFrame(data, SCHEMA), known).collect()] == [("s", 1, 0, 10, "a", None)]
    assert quality.normalized(spark.createDataFrame([], SCHEMA)).count() == 0
