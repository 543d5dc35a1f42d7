import json

from pyspark.sql import functions as F

from cuewright.sources import artifacts, captions
from cuewright.sources.tables import latest

VTT = "WEBVTT\n\nNOTE x\n\n1\n00:00.000 --> 00:10.000 align:start\n<b>Hello</b>\nworld\n\n01:00:00,500 --> 01:00:02.000\n\n\n00:11.000 --> 00:12.000\n  <i> </i>\n\r\n00:13.000 --> 00:14.000\nlast"


def test_vtt(spark):
    df = spark.createDataFrame([("s", VTT), ("t", None), ("u", "")], "source_id string, data string")
    assert [tuple(r) for r in captions.vtt_cues(df).orderBy("seg_idx").collect()] == [("s", 0, 0, 10_000, "Hello world"), ("s", 1, 13_000, 14_000, "last")]


def test_json3(spark):
    data = json.dumps({"events": [{"tStartMs": 0, "dDurationMs": 100, "segs": [{"utf8": "a"}, {"utf8": " b"}, {}]}, {"tStartMs": 5}, {"tStartMs": 7, "segs": [{"utf8": "\n"}]}, {"tStartMs": 9, "dDurationMs": 0, "segs": [{"utf8": "c"}]}]})
    df = spark.createDataFrame([("s", data), ("bad", "{"), ("null", None)], "source_id string, data string")
    assert [tuple(r) for r in captions.json3_cues(df).collect()] == [("s", 0, 0, 100, "a b"), ("s", 1, 9, 10, "c")]


def test_snippets(spark):
    df = spark.createDataFrame([("s", " hi ", 0.0005, 2.5), ("s", " ", 1.0, 1.0)], "source_id string, text string, start double, duration double")
    assert [tuple(r) for r in captions.snippet_cues(df).collect()] == [("s", 0, 2500, "hi")]


def test_listed_chapters_keep_their_number(spark):
    df = spark.createDataFrame([("s", [("a", 5.0, 5.0), (None, None, 2.0), ("c", 2.0, 3.0)])], "source_id string, chapters array<struct<title:string,start_time:double,end_time:double>>")
    assert [tuple(r) for r in captions.listed_chapters(df).orderBy("ord").collect()] == [("s", 2, "youtube-002", "Chapter 2", 0, 2000), ("s", 3, "youtube-003", "c", 2000, 3000)]


def test_track_choice(spark):
    rows = [("a", 0, "fr", "vtt"), ("a", 1, "de", "srt"), ("a", 2, "de", "vtt"), ("b", 0, "it", "x"), ("b", 1, "en-US", "vtt"), ("c", 0, "zz", "x"), ("c", 1, "yy", "vtt"), ("d", 0, "de-CH", "vtt"), ("d", 1, "en", "vtt"), (None, 0, "de", "vtt"), ("e", 0, None, "vtt")]
    got = captions.chosen_tracks(spark.createDataFrame(rows, "source_id string, ord int, language string, ext string"), "de-AT").collect()
    assert {r.source_id: (r.language, r.ext, r.ord) for r in got} == {"a": ("de", "vtt", 2), "b": ("en-US", "vtt", 1), "c": ("yy", "vtt", 1), "d": ("de-CH", "vtt", 0)}


def test_store(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert artifacts.get(spark, folder) is None
    one = spark.createDataFrame([('{"a":1}',), ('{"a":1}',), ("ä",), (None,)], "json string")
    artifacts.put(one, folder)
    artifacts.put(one.unionByName(spark.createDataFrame([("new",)], "json string")), folder)
    held = artifacts.get(spark, folder)
    assert sorted(r.json for r in held.collect()) == ["new", '{"a":1}', "ä"]
    assert tuple(artifacts.usage(held).first()) == (3, 12)
    good, bad = artifacts.checked(held.withColumn("json", F.when(F.col("json") == "new", "changed").otherwise(F.col("json"))))
    assert good.count() == 2 and bad.count() == 1
    assert artifacts.file_usage(spark, folder).first().files >= 3


def test_media_identity(spark, tmp_path):
    for name, content in (("a.mp3", b"x"), ("b/c.MP3", b"x"), ("d.txt", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = artifacts.media_identity(spark, str(tmp_path), (".mp3",)).collect()
    assert len(got) == 2 and len({r.source_id for r in got}) == 1 and len(got[0].source_id) == len("local:") + 64


def test_latest_is_decided_by_all_kept_columns(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 2, "b"), ("a", 2, "a"), (None, 9, "z")], "k string, at int, v string")
    assert [tuple(r) for r in latest(df, ["k"], "at", ["v"]).collect()] == [("a", "b")]


def test_files_stay_in_their_folder(spark, tmp_path):
    from cuewright.sources.sinks import write_files

    df = spark.createDataFrame([("a/b.md", "ä"), ("../up.md", "x"), ("/abs.md", "x"), ("none.md", None), (None, "x"), ("a/b.md", "z")], "path string, content string")
    got = {r.path: (r.bytes, r.error) for r in write_files(df, str(tmp_path / "out")).collect()}
    assert got == {"a/b.md": (1, None), "../up.md": (0, "leaves its folder"), "/abs.md": (0, "leaves its folder"), "none.md": (0, None)}
    assert (tmp_path / "out/a/b.md").read_text() == "z" and sorted(p.name for p in (tmp_path / "out").rglob("*.md")) == ["b.md", "none.md"]


def test_references(spark, tmp_path):
    from cuewright.sources.sinks import read_references

    (tmp_path / "a.json").write_text(json.dumps({"source_id": "s", "language": "en", "duration_ms": 9, "claims": [{"text": "t", "evidence": "e", "timestamp_ms": 1}]}))
    (tmp_path / "b.json").write_text("{")
    claims, bad = read_references(spark, str(tmp_path))
    assert [(r.source_id, r.claim_no, r.tolerance_ms) for r in claims.collect()] == [("s", 0, 30_000)] and bad.count() == 1
