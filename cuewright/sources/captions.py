"""Caption formats as tables of cues, and the choice of a caption track. Everything is built from JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuewright.functions.text import language_base, strip_tags, timecode_ms, to_ms

# Languages that are taken, in order, where none fits the request; formats that can be parsed.
FALLBACK = ("ko", "en", "ja", "en-orig", "en-US", "en-GB")
PARSED = ("json3", "vtt")

JSON3 = "events ARRAY<STRUCT<tStartMs: BIGINT, dDurationMs: BIGINT, segs: ARRAY<STRUCT<utf8: STRING>>>>"


def vtt_cues(tracks: DataFrame, key: str = "source_id", data: str = "data") -> DataFrame:
    """Cues of WebVTT or SubRip texts: ``key, seg_idx, start_ms, end_ms, text``. Blank cues are dropped, indexes count what is left.

    A block counts if it has a line ``time --> time``; lines before it (ids) and settings after it are ignored.
    """
    blocks = tracks.select(key, F.posexplode(F.split(F.regexp_replace(data, r"\r\n?", "\n"), r"\n[ \t]*\n")).alias("_k", "_b"))
    time = r"((?:\d+:)*\d{1,2}:\d{2}[.,]\d{1,3})"
    line = rf"(?m)^[ \t]*{time}[ \t]+-->[ \t]+{time}"
    body = F.regexp_extract(F.col("_b"), rf"(?s){time}[ \t]+-->[ \t]+{time}[^\n]*\n(.*)", 3)
    found = blocks.where(F.col("_b").rlike(line)).select(
        key, "_k", timecode_ms(F.regexp_extract("_b", line, 1)).alias("start_ms"), timecode_ms(F.regexp_extract("_b", line, 2)).alias("end_ms"), F.trim(strip_tags(F.regexp_replace(body, r"\n+", " "))).alias("text")
    )
    return _indexed(found.where("text <> ''"), key)


def json3_cues(tracks: DataFrame, key: str = "source_id", data: str = "data") -> DataFrame:
    """Cues of json3 captions: ``key, seg_idx, start_ms, end_ms, text``. Text that is no such JSON gives none; a cue lasts 1 ms at least."""
    events = tracks.select(key, F.posexplode(F.from_json(data, JSON3)["events"]).alias("_k", "_e"))
    text = F.trim(F.array_join(F.transform("_e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), F.lit(" \t\n\r"))
    start = F.coalesce("_e.tStartMs", F.lit(0))
    found = events.select(key, "_k", start.alias("start_ms"), (start + F.greatest(F.lit(1), F.coalesce("_e.dDurationMs", F.lit(1)))).alias("end_ms"), text.alias("text"))
    return _indexed(found.where("text <> ''"), key)


def snippet_cues(snippets: DataFrame, key: str = "source_id") -> DataFrame:
    """Cues of snippets ``text, start, duration`` in seconds: ``key, start_ms, end_ms, text``, blank ones dropped."""
    rows = snippets.select(key, to_ms(F.col("start")).alias("start_ms"), to_ms(F.col("start") + F.col("duration")).alias("end_ms"), F.trim("text").alias("text"))
    return rows.where("text <> ''")


def _indexed(found: DataFrame, key: str) -> DataFrame:
    by = Window.partitionBy(key).orderBy("_k")  # one track's cues
    return found.select(key, (F.row_number().over(by) - 1).alias("seg_idx"), "start_ms", "end_ms", "text")


def listed_chapters(infos: DataFrame, key: str = "source_id", chapters: str = "chapters") -> DataFrame:
    """Chapters of metadata ``chapters ARRAY<STRUCT<title, start_time, end_time>>`` in seconds: ``key, ord, chapter_id, title, start_ms, end_ms``.

    Those that don't end after their start are dropped; ids keep the number in the list.
    """
    each = infos.select(key, F.posexplode(chapters).alias("_k", "_c"))
    start, end = to_ms(F.coalesce("_c.start_time", F.lit(0.0))), to_ms(F.coalesce("_c.end_time", F.lit(0.0)))
    title = F.coalesce(F.nullif("_c.title", F.lit("")), F.concat(F.lit("Chapter "), F.col("_k") + 1))
    return each.select(key, (F.col("_k") + 1).alias("ord"), F.format_string("youtube-%03d", F.col("_k") + 1).alias("chapter_id"), title.alias("title"), start.alias("start_ms"), end.alias("end_ms")).where("end_ms > start_ms")


def language_rank(found: Column, wanted: Column) -> Column:
    """How well a caption language serves a request, 0 best: itself, its base, another of that base, the fallbacks, any."""
    exact, base = F.lower(found) == F.lower(wanted), F.lower(found) == language_base(wanted)
    rank = F.when(exact, 0).when(base, 1).when(language_base(found) == language_base(wanted), 2)
    for k, language in enumerate(FALLBACK):
        rank = rank.when(found == language, 3 + k)
    return rank.otherwise(3 + len(FALLBACK))


def chosen_tracks(tracks: DataFrame, wanted: str) -> DataFrame:
    """Of each source's tracks (``source_id, ord, language, ext``) the best language's first that can be parsed, else its first.

    ``ord`` is the place in the listing. One comparison of structs per source, combined before the shuffle.
    """
    rank = F.struct(language_rank(F.col("language"), F.lit(wanted)).alias("a"), (~F.coalesce(F.col("ext").isin(*PARSED), F.lit(False))).alias("b"), F.col("ord"), F.col("language"), F.col("ext"))
    best = tracks.where("source_id IS NOT NULL AND language IS NOT NULL").groupBy("source_id").agg(F.min(rank).alias("r"))
    return best.select("source_id", "r.language", "r.ext", "r.ord")
