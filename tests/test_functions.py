import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cuewright.functions import identity, text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("value, want", [("  a \n b ", "a b"), (" x　y", "x y"), ("", ""), (None, None)])
def test_clean_text(spark, value, want):
    assert one(spark, tx.clean_text(F.lit(value).cast("string"))) == want


def test_time(spark):
    assert [one(spark, tx.timecode_ms(F.lit(v))) for v in ("00:01.500", "1:00:00,250", "01:02:03.004", "x:1")] == [1500, 3_600_250, 3_723_004, None]
    assert [one(spark, tx.to_ms(F.lit(v))) for v in (0.0005, 0.0015, 2.5)] == [0, 2, 2500]
    assert [one(spark, tx.clock(F.lit(v))) for v in (65_000, 3_600_000, 36_061_999, 0)] == ["01:05", "01:00:00", "10:01:01", "00:00"]
    assert [one(spark, tx.quarter(F.lit(t), F.lit(100))) for t in (0, 24, 25, 99, 100, 400)] == [0, 0, 1, 3, 3, 3]


def test_names(spark):
    assert one(spark, tx.safe_name(F.lit(" .. "))) == "note" and one(spark, tx.safe_name(F.lit("a/b"))) == "a-b"
    assert [one(spark, tx.numbered("chapter", F.lit(n))) for n in (1, 999, 1234)] == ["chapter-001", "chapter-999", "chapter-1234"]
    assert one(spark, tx.fold_text(F.lit("STRAßE"))) == "strasse"


def test_languages(spark):
    ok = lambda a, b: one(spark, tx.language_accepted(F.lit(a), F.lit(b)))
    assert ok("de-AT", "de") and ok("en-GB", "fr") and not ok("fr", "de")


def test_outcomes(spark):
    said = lambda e, o: one(spark, tx.outcome(F.lit(e).cast("string"), F.lit(o)))
    assert said("Error: NOT LOGGED IN", "") == "auth" and said("", "HTTP 429") == "rate_limit" and said("odd", "429") == "error" and said(None, "boom") == "error"
    assert one(spark, tx.unfenced(F.lit('```json\n{"a":1}\n```'))) == '{"a":1}'
    assert one(spark, tx.first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("x"))) == "x"


@pytest.mark.parametrize("depth, minutes, cap", [("quick", 90, 3), ("deep", 10, 15), ("detailed", 30, 5), ("detailed", 31, 8), ("other", 61, 12)])
def test_chapter_cap(spark, depth, minutes, cap):
    assert one(spark, tx.chapter_cap(F.lit(depth), F.lit(minutes * 60_000))) == cap


ID = "abcDEF_1234"


@pytest.mark.parametrize(
    "url, want",
    [
        (f"https://www.youtube.com/watch?v={ID}", ID), (f"https://youtube.com/watch?list=x&v={ID}&t=3", ID), (f"https://youtu.be/{ID}?t=9", ID), (f"https://m.youtube.com/shorts/{ID}", ID), (f"https://www.youtube.com/embed/{ID}#x", ID),
        (f"https://other.com/watch?v={ID}", None), ("https://www.youtube.com/watch?v=short", None), ("no address", None), (None, None), (f"https://youtu.be/{ID}x", None),
    ],
)
def test_video_ids(spark, url, want):
    assert one(spark, identity.video_id(F.lit(url).cast("string"))) == want


def test_media(spark):
    assert [one(spark, identity.looks_like_media(F.lit(v))) for v in ("/a/b.MP3", "file:///x.m4a", "https://x/y.mp3", "notes.txt", "mp3")] == [True, True, False, False, False]


def test_fingerprint_is_that_of_compact_sorted_json(spark):
    value = {"b": 'q"\\\n한', "a": None, "c": [1, 2]}
    got = one(spark, identity.fingerprint(c=F.array(F.lit(1), F.lit(2)), a=F.lit(None).cast("string"), b=F.lit(value["b"])))
    assert got == hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, identity.artifact_path(F.lit("abcd"))) == "ab/cd.json.zst"
