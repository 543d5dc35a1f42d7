"""Queries over cleaned transcripts, their quality, chapters and topics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cuewright.functions.text import SPACE, language_base
from cuewright.operators import quality, segmentation
from cuewright.sources.captions import chosen_tracks
from cuewright.sources.tables import table, valid_transcripts
from cuewright.staging import stage


def _cues(spark: SparkSession, folder: str) -> DataFrame:
    return stage(quality.usable_cues(table(spark, folder, "segments"), table(spark, folder, "transcripts")), "cues")


def _transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return valid_transcripts(table(spark, folder, "transcripts"), ["duration_ms"])


def cue_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return quality.normalized(_cues(spark, folder))


def source_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return quality.covered(_cues(spark, folder))


def largest_gaps(spark: SparkSession, folder: str) -> DataFrame:
    cues = _cues(spark, folder)
    return quality.largest_gaps(cues, quality.durations(cues, _transcripts(spark, folder)))


def repetition_share(spark: SparkSession, folder: str) -> DataFrame:
    return quality.repetition(_cues(spark, folder)).select("source_id", "cues", "most", (F.col("most") / F.col("cues")).alias("share"))


def monotonic_check(spark: SparkSession, folder: str) -> DataFrame:
    return quality.out_of_order(_cues(spark, folder))


def validation_report(spark: SparkSession, folder: str) -> DataFrame:
    cues = _cues(spark, folder)
    found = quality.report(cues, quality.durations(cues, _transcripts(spark, folder)))
    return found.select("source_id", "accepted", "coverage", "gap_ms", F.array_join("reasons", ",").alias("reasons"))


# Where transcripts come from, in the order they are preferred; those that local media have, and that must be asked for.
PROVIDERS = ("manual_subtitle", "transcript_api", "auto_subtitle", "user_provided", "whisper")
LOCAL, OPTIONAL = ("user_provided", "whisper"), ("whisper",)


def _fallback(spark: SparkSession, folder: str, include_optional: bool) -> DataFrame:
    """Every delivered transcript is a candidate of its source, ranked by where it comes from and then by its time; its quality is that of the source's cues."""
    rows = table(spark, folder, "transcripts").where("source_id IS NOT NULL")
    sources = table(spark, folder, "sources")
    local = sources.where("kind = 'local_media' AND source_id IS NOT NULL").select("source_id").distinct().withColumn("_l", F.lit(True))
    order = F.coalesce(*[F.when(F.col("provenance") == p, F.lit(k)) for k, p in enumerate(PROVIDERS)], F.lit(len(PROVIDERS)))
    by = Window.partitionBy("source_id").orderBy(order, "ingested_at", "provenance", "language", "title", "duration_ms")  # a source's deliveries
    scope = F.when(F.col("_l") & F.col("provenance").isin(*LOCAL), "local").otherwise("remote")
    listed = F.when(F.col("provenance").isin("manual_subtitle", "transcript_api"), F.array(F.concat("source_id", F.lit("/"), "provenance")))
    ranked = rows.join(local, "source_id", "left").select(
        "source_id", F.row_number().over(by).alias("rank"), F.col("provenance").alias("provider"), scope.alias("scope"), F.col("provenance").isin(*OPTIONAL).alias("optional"), F.nullif(F.trim("language"), F.lit("")).alias("language"), "title", listed.alias("chapters")
    )
    cues = _cues(spark, folder)
    lengths = quality.durations(cues, _transcripts(spark, folder))
    clean = stage(quality.normalized(cues), "normalized")
    judged = quality.report(clean, quality.durations(clean, _transcripts(spark, folder))).select("source_id", F.filter("reasons", lambda r: r != quality.REASONS[0]).alias("reasons"))
    checks = quality.out_of_order(cues).join(judged, "source_id", "full").join(lengths.select("source_id"), "source_id", "left_semi")
    return quality.resolved(quality.offered(ranked, sources, include_optional), "en", checks)


def provider_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """The transcript of each source that is taken, and why those before it were not."""
    said = lambda a: F.concat(a["provider"], F.lit(":"), F.array_join(a["reasons"], "+"))
    return _fallback(spark, folder, False).select("source_id", "provider", "language", "title", F.array_join("chapters", ",").alias("chapters"), F.array_join(F.transform("attempts", said), ",").alias("attempts"))


def provider_fallback_all(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the optional providers."""
    return _fallback(spark, folder, True).select("source_id", "provider", "language", "title")


def language_choice(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "transcripts").select("source_id", F.unix_micros("ingested_at").alias("ord"), "language", F.when(F.col("provenance").like("%subtitle"), "vtt").otherwise("text").alias("ext"))
    return chosen_tracks(rows, "de-AT").select("source_id", "language", "ext")


def language_bases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "transcripts").groupBy(language_base(F.col("language")).alias("base")).agg(F.count("*").alias("n"))


def _chapters(spark: SparkSession, folder: str, usable: DataFrame) -> DataFrame:
    lengths = quality.durations(usable, _transcripts(spark, folder))
    closed = segmentation.closed_chapters(table(spark, folder, "chapters"), table(spark, folder, "transcripts"))
    return segmentation.coalesced(closed, lengths, "detailed")


def chapter_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    return _chapters(spark, folder, _cues(spark, folder))


def topic_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    usable = _cues(spark, folder)
    return segmentation.topics(_chapters(spark, folder, usable), quality.normalized(usable, short=True)).select("source_id", "topic_id", "title", "start_ms", "end_ms")


def topic_assignment(spark: SparkSession, folder: str) -> DataFrame:
    usable = _cues(spark, folder)
    cues = stage(quality.normalized(usable, short=True), "normalized")
    chapters = _chapters(spark, folder, usable)
    found = segmentation.topic_cues(stage(segmentation.topics(chapters, cues), "topics"), cues)
    return found.select("source_id", "topic_id", F.array_join(F.transform("seg_indexes", lambda i: i.cast("string")), ",").alias("cues"))


def chapter_cues(spark: SparkSession, folder: str) -> DataFrame:
    """Interval join: cues and words of every valid chapter."""
    closed = segmentation.closed_chapters(table(spark, folder, "chapters"), table(spark, folder, "transcripts")).where("end_ms > start_ms")
    as_topics = closed.select("source_id", F.col("chapter_id").alias("topic_id"), F.lit(1).alias("position"), F.col("start_ms").alias("chapter_start"), "start_ms", "end_ms")
    found = segmentation.topic_cues(as_topics, _cues(spark, folder))
    return found.select("source_id", F.col("topic_id").alias("chapter_id"), F.size("seg_indexes").cast("bigint").alias("cues"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (cue_normalize, source_coverage, largest_gaps, repetition_share, monotonic_check, validation_report, provider_fallback, provider_fallback_all, language_choice, language_bases, chapter_coalesce, topic_boundaries, topic_assignment, chapter_cues)
}

_TR = """
    tr AS (SELECT source_id, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ingested_at DESC, duration_ms DESC NULLS LAST) AS k FROM transcripts WHERE source_id IS NOT NULL) WHERE k = 1)
"""
_CUES = (
    _TR
    + """,
    u AS (SELECT source_id, seg_idx, start_ms, end_ms, text, speaker FROM (
          SELECT s.*, row_number() OVER (PARTITION BY s.source_id, seg_idx ORDER BY start_ms, end_ms, text NULLS FIRST, speaker NULLS FIRST) AS k
          FROM segments s SEMI JOIN tr ON tr.source_id = s.source_id WHERE seg_idx IS NOT NULL AND start_ms >= 0 AND end_ms > start_ms) WHERE k = 1),
    dur AS (SELECT tr.source_id, greatest(duration_ms, e) AS duration_ms FROM tr LEFT JOIN (SELECT source_id, max(end_ms) AS e FROM u GROUP BY 1) USING (source_id) WHERE greatest(duration_ms, e) > 0)
"""
)
_NORMAL = (
    _CUES
    + f""",
    n1 AS (SELECT * FROM (SELECT source_id, seg_idx, start_ms, end_ms, trim(regexp_replace(text, '{SPACE}+', ' ', 'g')) AS text, speaker FROM u) WHERE text <> ''),
    n2 AS (SELECT *, CASE WHEN lag(text) OVER w = text THEN 0 ELSE 1 END AS f FROM n1 WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, end_ms, seg_idx)),
    n3 AS (SELECT *, sum(f) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, seg_idx ROWS UNBOUNDED PRECEDING) AS run FROM n2),
    n4 AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY source_id, run ORDER BY start_ms, end_ms, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM n3),
    n5 AS (SELECT *, sum(b) OVER (PARTITION BY source_id, run ORDER BY start_ms, end_ms, seg_idx ROWS UNBOUNDED PRECEDING) AS isl FROM n4),
    norm AS (SELECT source_id, arg_min(seg_idx, (start_ms, end_ms, seg_idx)) AS seg_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms, any_value(text) AS text,
             arg_min_null(speaker, (start_ms, end_ms, seg_idx)) AS speaker FROM n5 GROUP BY source_id, run, isl)
"""
)
_COVERED = """,
    cov AS (SELECT source_id, CAST(sum(greatest(0, end_ms - greatest(start_ms, coalesce(r, start_ms)))) AS BIGINT) AS covered_ms FROM (
            SELECT *, max(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM u) GROUP BY 1)
"""
_GAPS = """,
    gap AS (SELECT source_id, CAST(greatest(g, duration_ms - last) AS BIGINT) AS gap_ms FROM (
            SELECT source_id, max(start_ms - coalesce(p, 0)) AS g, arg_max(end_ms, (start_ms, seg_idx)) AS last FROM (
              SELECT *, lag(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, seg_idx) AS p FROM u) GROUP BY 1) LEFT JOIN dur USING (source_id))
"""
_REPEATED = """,
    rep AS (SELECT source_id, CAST(sum(n) AS BIGINT) AS cues, max(n) AS most FROM (SELECT source_id, replace(lower(trim(text)), 'ß', 'ss') AS t, count(*) AS n FROM u WHERE trim(text) <> '' GROUP BY 1, 2) GROUP BY 1)
"""
_ORDER = """,
    ord AS (SELECT source_id, coalesce(bool_or(start_ms < p), false) AS disordered FROM (SELECT source_id, start_ms, lag(start_ms) OVER (PARTITION BY source_id ORDER BY seg_idx) AS p FROM u) GROUP BY 1)
"""
_CLOSED = """,
    ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, chapter_id ORDER BY received_at DESC, ord DESC, title DESC NULLS LAST, start_ms DESC, end_ms DESC NULLS LAST) AS k FROM chapters
           WHERE source_id IS NOT NULL AND chapter_id IS NOT NULL) WHERE k = 1 AND start_ms IS NOT NULL),
    cl AS (SELECT * FROM (SELECT ch.source_id, chapter_id, ord, title, start_ms, coalesce(end_ms, lead(start_ms) OVER (PARTITION BY ch.source_id ORDER BY start_ms, ord, chapter_id), duration_ms) AS end_ms
           FROM ch LEFT JOIN tr USING (source_id)) WHERE end_ms IS NOT NULL)
"""
_COALESCED = """,
    c1 AS (SELECT cl.*, count(*) OVER (PARTITION BY cl.source_id) AS n, row_number() OVER (PARTITION BY cl.source_id ORDER BY start_ms, ord, chapter_id) - 1 AS k,
           CASE WHEN duration_ms <= 1800000 THEN 5 WHEN duration_ms <= 3600000 THEN 8 ELSE 12 END AS cap FROM cl JOIN dur USING (source_id) WHERE end_ms > start_ms),
    c2 AS (SELECT *, k // (CASE WHEN n <= cap THEN 1 ELSE CAST(ceil(n / cap) AS BIGINT) END) AS g FROM c1),
    cc AS (SELECT source_id, CASE WHEN any_value(n > cap) THEN format('chapter-{:03d}', g + 1) ELSE arg_min(chapter_id, k) END AS chapter_id, arg_min_null(title, k) AS title, min(start_ms) FILTER (k = g * (CASE WHEN n <= cap THEN 1 ELSE CAST(ceil(n / cap) AS BIGINT) END)) AS start_ms, arg_max(end_ms, k) AS end_ms
           FROM c2 GROUP BY source_id, g
           UNION ALL SELECT source_id, 'full-video', 'Full recording', 0, duration_ms FROM dur ANTI JOIN c1 USING (source_id))
"""
_TOPICS = """,
    m1 AS (SELECT source_id, end_ms AS tm, CASE WHEN regexp_matches(rtrim(text), '[.?!]$') THEN 30000 ELSE 0 END + least(30000, greatest(0, coalesce(lead(start_ms) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, seg_idx), end_ms) - end_ms)) AS score FROM norm),
    m2 AS (SELECT cc.source_id, chapter_id, list(struct_pack(tm := tm, score := score)) AS marks FROM cc JOIN m1 ON m1.source_id = cc.source_id AND tm > cc.start_ms AND tm <= cc.end_ms WHERE end_ms - start_ms > 600000 GROUP BY 1, 2),
    w AS (SELECT cc.source_id, cc.chapter_id, title, start_ms AS cs, end_ms AS ce, coalesce(marks, []) AS marks, 0 AS pos, start_ms AS s, start_ms AS z FROM cc LEFT JOIN m2 USING (source_id, chapter_id)
          UNION ALL
          SELECT source_id, chapter_id, title, cs, ce, marks, pos + 1, z, CASE WHEN ce - cs <= 600000 THEN ce ELSE
            least(CASE WHEN ce - stop < 150000 THEN ce ELSE stop END, z + 600000) END
          FROM (SELECT *, coalesce(list_max(list_transform(list_filter(marks, lambda x: x.tm >= greatest(z + 1, least(z + 300000, ce) - 60000) AND x.tm <= least(least(z + 600000, ce), least(z + 300000, ce) + 60000)),
                 lambda x: struct_pack(v := x.score - abs(x.tm - least(z + 300000, ce)) * CAST(0.25 AS DOUBLE), tm := x.tm))).tm, least(z + 300000, ce)) AS stop FROM w WHERE z < ce)),
    tp AS (SELECT source_id, chapter_id, chapter_id || '-topic-' || format('{:03d}', pos) AS topic_id, CASE WHEN count(*) OVER (PARTITION BY source_id, chapter_id) = 1 THEN title ELSE title || ' · ' || pos END AS title,
           pos, cs, s AS start_ms, z AS end_ms FROM w WHERE pos > 0)
"""
_P = ", ".join(f"WHEN '{p}' THEN {k}" for k, p in enumerate(PROVIDERS)).replace(",", "")
_RESOLVED = (
    f"WITH {_NORMAL},"
    + """
    nd AS (SELECT tr.source_id, greatest(duration_ms, e) AS duration_ms FROM tr LEFT JOIN (SELECT source_id, max(end_ms) AS e FROM norm GROUP BY 1) USING (source_id) WHERE greatest(duration_ms, e) > 0),
    oo AS (SELECT source_id, coalesce(bool_or(start_ms < p), false) AS a FROM (SELECT source_id, start_ms, lag(start_ms) OVER (PARTITION BY source_id ORDER BY seg_idx) AS p FROM u) GROUP BY 1),
    q AS (SELECT source_id, sum(greatest(0, end_ms - greatest(start_ms, coalesce(r, start_ms)))) AS c FROM (SELECT *, max(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM norm) GROUP BY 1),
    g AS (SELECT source_id, max(start_ms - coalesce(p, 0)) AS i, arg_max(end_ms, (start_ms, seg_idx)) AS l FROM (SELECT *, lag(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, seg_idx) AS p FROM norm) GROUP BY 1),
    rp AS (SELECT source_id, sum(n) AS n, max(n) AS m FROM (SELECT source_id, count(*) AS n FROM norm WHERE trim(text) <> '' GROUP BY source_id, replace(lower(trim(text)), 'ß', 'ss')) GROUP BY 1),
    ck AS (SELECT dur.source_id, coalesce(a, false) AS a, concat_ws('+', CASE WHEN c / nd.duration_ms < CAST(0.6 AS DOUBLE) THEN 'coverage' END, CASE WHEN c IS NOT NULL AND n IS NULL THEN 'empty_text' END, CASE WHEN n >= 4 AND m / n > CAST(0.5 AS DOUBLE) THEN 'excessive_repetition' END,
           CASE WHEN greatest(i, nd.duration_ms - l) > greatest(120000, round_even(nd.duration_ms * CAST(0.2 AS DOUBLE), 0)) THEN 'large_gap' END) AS r
           FROM dur LEFT JOIN oo USING (source_id) LEFT JOIN nd USING (source_id) LEFT JOIN q USING (source_id) LEFT JOIN g USING (source_id) LEFT JOIN rp USING (source_id)),
    lm AS (SELECT DISTINCT source_id FROM sources WHERE kind = 'local_media' AND source_id IS NOT NULL),
    r0 AS (SELECT t.source_id, row_number() OVER (PARTITION BY t.source_id ORDER BY CASE provenance """
    + f"{_P} ELSE {len(PROVIDERS)} END"
    + """, ingested_at NULLS FIRST, provenance NULLS FIRST, language NULLS FIRST, title NULLS FIRST, duration_ms NULLS FIRST) AS rank, provenance AS provider, nullif(trim(language), '') AS language, nullif(title, '') AS title,
           CASE WHEN provenance IN ('manual_subtitle', 'transcript_api') THEN t.source_id || '/' || provenance END AS chapters, t.source_id IN (SELECT source_id FROM lm) AS loc FROM transcripts t WHERE t.source_id IS NOT NULL),
    r1 AS (SELECT *, CASE WHEN loc THEN CASE WHEN provider IN ('user_provided', 'whisper') THEN 'yes' ELSE 'no' END WHEN provider = 'whisper' THEN 'optional' ELSE 'yes' END AS s FROM r0),
    v AS (SELECT r1.*, CASE WHEN language IS NULL THEN 'not_available' WHEN split_part(lower(language), '-', 1) NOT IN ('en', 'ko', 'ja') THEN 'language_mismatch' WHEN a THEN 'timestamps_not_monotonic' WHEN r <> '' THEN r END AS why FROM r1 LEFT JOIN ck USING (source_id) WHERE s <> 'no' AND {0}),
    b AS (SELECT *, first_value(title IGNORE NULLS) OVER w AS t1, first_value(chapters IGNORE NULLS) OVER w AS c1, min(CASE WHEN why IS NULL THEN rank END) OVER (PARTITION BY source_id) AS win FROM v WINDOW w AS (PARTITION BY source_id ORDER BY rank)),
    won AS (SELECT source_id, max(CASE WHEN rank = win THEN provider END) AS provider, max(CASE WHEN rank = win THEN language END) AS language, max(CASE WHEN rank = win THEN coalesce(title, t1) END) AS title, max(CASE WHEN rank = win THEN coalesce(chapters, c1) END) AS chapters,
            coalesce(string_agg(provider || ':' || why, ',' ORDER BY rank) FILTER (win IS NULL OR rank < win), '') AS attempts FROM b GROUP BY 1)"""
)
SQL: dict[str, str] = {
    "cue_normalize": f"WITH {_NORMAL} SELECT * FROM norm",
    "source_coverage": f"WITH {_CUES}{_COVERED} SELECT * FROM cov",
    "largest_gaps": f"WITH {_CUES}{_GAPS} SELECT * FROM gap",
    "repetition_share": f"WITH {_CUES}{_REPEATED} SELECT *, most / cues AS share FROM rep",
    "monotonic_check": f"WITH {_CUES}{_ORDER} SELECT * FROM ord",
    "validation_report": f"""
        WITH {_CUES}{_COVERED}{_GAPS}{_REPEATED}{_ORDER},
        f AS (SELECT source_id, covered_ms / duration_ms AS coverage, gap_ms, disordered AS a, covered_ms / duration_ms < CAST(0.6 AS DOUBLE) AS b, cues IS NULL AS c, cues >= 4 AND most / cues > CAST(0.5 AS DOUBLE) AS d,
              gap_ms > greatest(120000, round_even(duration_ms * CAST(0.2 AS DOUBLE), 0)) AS e FROM dur JOIN cov USING (source_id) JOIN gap USING (source_id) JOIN ord USING (source_id) LEFT JOIN rep USING (source_id)),
        g AS (SELECT *, concat_ws(',', CASE WHEN a THEN 'timestamps_not_monotonic' END, CASE WHEN b THEN 'coverage' END, CASE WHEN c THEN 'empty_text' END, CASE WHEN d THEN 'excessive_repetition' END, CASE WHEN e THEN 'large_gap' END) AS reasons FROM f)
        SELECT source_id, reasons = '' AS accepted, coverage, gap_ms, reasons FROM g
    """,
    "provider_fallback": _RESOLVED.replace("{0}", "s <> 'optional'") + " SELECT source_id, provider, language, title, chapters, attempts FROM won",
    "provider_fallback_all": _RESOLVED.replace("{0}", "true") + " SELECT source_id, provider, language, title FROM won",
    "language_choice": """
        WITH t AS (SELECT source_id, epoch_us(ingested_at) AS ord, language, CASE WHEN provenance LIKE '%subtitle' THEN 'vtt' ELSE 'text' END AS ext,
                   CASE WHEN lower(language) = 'de-at' THEN 0 WHEN lower(language) = 'de' THEN 1 WHEN split_part(lower(language), '-', 1) = 'de' THEN 2 WHEN language = 'ko' THEN 3 WHEN language = 'en' THEN 4
                        WHEN language = 'ja' THEN 5 WHEN language = 'en-orig' THEN 6 WHEN language = 'en-US' THEN 7 WHEN language = 'en-GB' THEN 8 ELSE 9 END AS r FROM transcripts WHERE source_id IS NOT NULL AND language IS NOT NULL)
        SELECT source_id, language, ext FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY r, CASE WHEN ext IN ('json3', 'vtt') THEN 0 ELSE 1 END, ord NULLS FIRST, language, ext) AS k FROM t) WHERE k = 1
    """,
    "language_bases": "SELECT split_part(lower(language), '-', 1) AS base, count(*) AS n FROM transcripts GROUP BY 1",
    "chapter_coalesce": f"WITH {_CUES}{_CLOSED}{_COALESCED} SELECT * FROM cc",
    "topic_boundaries": f"WITH RECURSIVE {_NORMAL}{_CLOSED}{_COALESCED}{_TOPICS} SELECT source_id, topic_id, title, start_ms, end_ms FROM tp",
    "topic_assignment": f"""
        WITH RECURSIVE {_NORMAL}{_CLOSED}{_COALESCED}{_TOPICS},
        l AS (SELECT source_id, topic_id, CASE WHEN pos = 1 THEN start_ms ELSE greatest(cs, start_ms - 15000) END AS f, end_ms AS t FROM tp)
        SELECT l.source_id, topic_id, coalesce(string_agg(CAST(seg_idx AS VARCHAR), ',' ORDER BY seg_idx), '') AS cues FROM l LEFT JOIN norm n ON n.source_id = l.source_id AND n.end_ms > f AND n.start_ms < t GROUP BY 1, 2
    """,
    "chapter_cues": f"""
        WITH {_CUES}{_CLOSED} SELECT c.source_id, chapter_id, count(u.seg_idx) AS cues FROM cl c LEFT JOIN u ON u.source_id = c.source_id AND u.end_ms > c.start_ms AND u.start_ms < c.end_ms WHERE c.end_ms > c.start_ms GROUP BY 1, 2
    """,
}
