"""Queries over identities, formats, packs, documents, retention and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuewright.functions import identity, text as tx
from cuewright.operators import documents as docs, graph, quality, retention, scoring, segmentation, synthesis
from cuewright.operators.ordered import CELL_MS, cell
from cuewright.sources import artifacts, captions
from cuewright.sources.tables import latest, table, valid_chapters, valid_transcripts
from cuewright.staging import stage
from cuewright.streaming.sessions import sessions as session_windows

NOW = "2025-12-01T00:00:00Z"


def url_identity(spark: SparkSession, folder: str) -> DataFrame:
    urls = table(spark, folder, "sources").where("canonical_url IS NOT NULL").select("canonical_url").distinct()
    vid = identity.video_id(F.col("canonical_url"))
    return urls.select("canonical_url", identity.url_host(F.col("canonical_url")).alias("host"), vid.alias("video_id"), identity.canonical_url(vid).alias("canonical"), identity.looks_like_media(F.col("canonical_url")).alias("is_media"))


def source_identities(spark: SparkSession, folder: str) -> DataFrame:
    """One row per source: of its copies the least url and path, and whether it has what its kind needs."""
    rows = table(spark, folder, "sources").where("source_id IS NOT NULL")
    one = rows.groupBy("source_id").agg(F.count("*").alias("rows"), F.min("kind").alias("kind"), F.min("video_id").alias("video_id"), F.min("canonical_url").alias("url"), F.min("local_path").alias("path"))
    whole = ((F.col("kind") == "youtube") & (F.coalesce("video_id", F.lit("")) != "")) | ((F.col("kind") == "local_media") & (F.coalesce("path", F.lit("")) != ""))
    return one.withColumn("complete", whole)


def content_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    rows = valid_transcripts(table(spark, folder, "transcripts"), ["language", "title", "provenance", "duration_ms"])
    return rows.select("source_id", identity.fingerprint(source_id=F.col("source_id"), language=F.col("language"), title=F.col("title"), provenance=F.col("provenance"), duration_ms=F.col("duration_ms")).alias("fingerprint"))


def content_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("digest"))
    return rows.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).withColumn("path", identity.artifact_path(F.col("digest")))


def artifact_usage(spark: SparkSession, folder: str) -> DataFrame:
    return artifacts.usage(artifacts.addressed(table(spark, folder, "documents"), "text"))


def clock_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "evidence").where("start_ms IS NOT NULL").groupBy("evidence_id").agg(F.min("start_ms").alias("start_ms"), F.min("provenance").alias("provenance"))
    return rows.select("evidence_id", tx.clock(F.col("start_ms")).alias("label"), tx.provenance_label(F.col("provenance")).alias("origin"))


def safe_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = valid_chapters(table(spark, folder, "chapters"))
    return rows.select("source_id", "chapter_id", tx.safe_name(F.col("title")).alias("name"), tx.numbered("part", F.col("ord")).alias("part"))


def time_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """How far the time that a cue's text begins with is from the cue's own, by how the time is written."""
    mark = F.regexp_extract("text", r"^[\[(<]?(\d+:\d\d(?::\d\d)?(?:[.,]\d+)?)", 1)
    rows = table(spark, folder, "segments").select("start_ms", mark.alias("code")).where("code <> ''")
    parts = F.size(F.split("code", ":")).alias("parts")
    return rows.groupBy(parts).agg(F.count("*").alias("cues"), F.sum(F.abs(tx.timecode_ms(F.col("code")) - F.col("start_ms"))).cast("bigint").alias("apart_ms"))


def clean_cues(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "segments").where("text IS NOT NULL").select(tx.fold_text(tx.clean_text(tx.strip_tags(F.col("text")))).alias("text"))
    return rows.groupBy("text").agg(F.count("*").alias("cues")).where("cues > 1 AND text <> ''")


def half_even_ms(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    return rows.select("event_id", tx.to_ms(F.col("value")).alias("ms"))


def quarter_coverage(spark: SparkSession, folder: str) -> DataFrame:
    claims = table(spark, folder, "reference_claims").where("timestamp_ms IS NOT NULL").select("source_id", "claim_id", "timestamp_ms").distinct()
    lengths = valid_transcripts(table(spark, folder, "transcripts"), ["duration_ms"]).where("duration_ms IS NOT NULL")
    return claims.join(lengths, "source_id").groupBy("source_id").agg(F.count_distinct(tx.quarter(F.col("timestamp_ms"), F.col("duration_ms"))).alias("quarters"))


def row_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per table that break a rule of the data model."""
    rules = {
        "segments": ("end_after_start", F.col("end_ms") > F.col("start_ms")),
        "chapters": ("end_after_start", F.col("end_ms") > F.col("start_ms")),
        "evidence": ("source_claims_have_time", (F.col("provenance") != "source") | F.col("start_ms").isNotNull()),
        "transcripts": ("has_duration", F.col("duration_ms") > 0),
        "sources": ("has_address", F.col("canonical_url").isNotNull() | F.col("local_path").isNotNull()),
    }
    out = None
    for name, (rule, holds) in rules.items():
        one = table(spark, folder, name).agg(F.lit(name).alias("table"), F.lit(rule).alias("rule"), F.count("*").alias("rows"), F.count_if(~F.coalesce(holds, F.lit(False))).alias("broken"))
        out = one if out is None else out.unionByName(one)
    return out


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """Cues as captions show them, by (source, hour) so that no recording becomes one text."""
    cues = quality.usable_cues(table(spark, folder, "segments"), table(spark, folder, "transcripts"))
    body = tx.clean_text(tx.strip_tags(F.col("text")))
    return cues.select(F.concat("source_id", F.lit("#"), cell(F.col("start_ms"), CELL_MS)).alias("source_id"), "seg_idx", "start_ms", "end_ms", body.alias("text")).where("text <> ''")


def vtt_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Cues written as WebVTT, where an arrow in a text has to be written as an entity, and read again."""
    code = lambda c: F.format_string("%02d:%02d:%02d.%03d", F.floor(F.col(c) / 3_600_000), F.floor(F.col(c) / 60_000) % 60, F.floor(F.col(c) / 1000) % 60, F.col(c) % 1000)
    block = F.concat(code("start_ms"), F.lit(" --> "), code("end_ms"), F.lit("\n"), F.replace(F.col("text"), F.lit("-->"), F.lit("--&gt;")))
    files = _written(spark, folder).groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("start_ms", "seg_idx", block.alias("b")))).alias("l"))
    files = files.select("source_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("l", lambda x: x["b"]), "\n\n")).alias("data"))
    return captions.vtt_cues(files).select(F.substring_index("source_id", "#", 1).alias("source_id"), "start_ms", "end_ms", F.replace("text", F.lit("--&gt;"), F.lit("-->")).alias("text"))


def json3_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Cues written as json3 and read again."""
    event = F.struct(F.col("start_ms").alias("tStartMs"), (F.col("end_ms") - F.col("start_ms")).alias("dDurationMs"), F.array(F.struct(F.col("text").alias("utf8"))).alias("segs"))
    files = _written(spark, folder).groupBy("source_id").agg(F.to_json(F.struct(F.collect_list(event).alias("events"))).alias("data"))
    return captions.json3_cues(files).select(F.substring_index("source_id", "#", 1).alias("source_id"), "start_ms", "end_ms", "text")


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence rows, each id once."""
    rows = table(spark, folder, "evidence").where("evidence_id IS NOT NULL")
    one = rows.groupBy("evidence_id").agg(F.min(F.struct("source_id", "topic_id", "claim_no", "text", "start_ms", "end_ms", "provenance")).alias("e"))
    return one.select("evidence_id", "e.*")


def topic_packs(spark: SparkSession, folder: str) -> DataFrame:
    made = synthesis.topic_packs(_claims(spark, folder))
    return made.select("source_id", "chapter_id", "topic_id", F.size("claims").cast("bigint").alias("claims"), "fingerprint")


def source_packs(spark: SparkSession, folder: str) -> DataFrame:
    """A pack per source, over the fingerprints of its topics."""
    titles = valid_transcripts(table(spark, folder, "transcripts"), ["title"])
    return synthesis.source_packs(synthesis.topic_packs(_claims(spark, folder)), titles)


def digest_document(spark: SparkSession, folder: str) -> DataFrame:
    return docs.digests(synthesis.topic_packs(_claims(spark, folder)), valid_chapters(table(spark, folder, "chapters")))


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    rows = valid_chapters(table(spark, folder, "chapters"))
    return rows.select("source_id", F.col("chapter_id").alias("topic_id"), F.coalesce("title", F.lit("")).alias("title"), F.concat(F.lit("From "), tx.clock(F.col("start_ms"))).alias("summary"))


def vault_notes(spark: SparkSession, folder: str) -> DataFrame:
    urls = table(spark, folder, "sources").where("source_id IS NOT NULL").groupBy("source_id").agg(F.min("canonical_url").alias("canonical_url"))
    return docs.vault(_notes(spark, folder), urls)


def vault_links(spark: SparkSession, folder: str) -> DataFrame:
    return docs.vault_index(_notes(spark, folder))


def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = valid_transcripts(table(spark, folder, "transcripts"), ["title", "duration_ms", "provenance"])
    return docs.as_json(rows, "source_id", pretty=False)


def topic_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Every topic's text through the default generator."""
    usable = stage(quality.usable_cues(table(spark, folder, "segments"), table(spark, folder, "transcripts")), "cues")
    cues = stage(quality.normalized(usable, short=True), "normalized")
    lengths = quality.durations(usable, valid_transcripts(table(spark, folder, "transcripts"), ["duration_ms"]))
    chapters = segmentation.coalesced(segmentation.closed_chapters(table(spark, folder, "chapters"), table(spark, folder, "transcripts")), lengths, "detailed")
    held = segmentation.topic_cues(stage(segmentation.topics(chapters, cues), "topics"), cues)
    texts = usable.select("source_id", "seg_idx", tx.clean_text(F.col("text")).alias("text"))  # of joined cues the first one's
    made = synthesis.generated(synthesis.topic_requests(held, texts), ["source_id", "topic_id"], "text")
    return made.select("source_id", "topic_id", "summary", F.array_join("concepts", ",").alias("concepts"), "attempts", "error")


def _objects(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("digest"), "created_at", "source_id", F.octet_length("text").cast("bigint").alias("size"))
    objects = rows.groupBy("digest").agg(F.max("created_at").alias("modified_at"), F.max("size").alias("size"))
    referenced = rows.where("source_id IS NOT NULL").select(F.col("source_id").alias("run_id"), "digest").distinct()
    exported = table(spark, folder, "sources").where("kind = 'local_media'").select(F.col("source_id").alias("run_id")).distinct()
    return objects, referenced, exported


def retention_compact(spark: SparkSession, folder: str) -> DataFrame:
    objects, referenced, _ = _objects(spark, folder)
    return retention.compact(objects, referenced, F.to_timestamp(F.lit(NOW)))


def retention_private(spark: SparkSession, folder: str) -> DataFrame:
    return retention.private(*_objects(spark, folder))


def claim_scores(spark: SparkSession, folder: str) -> DataFrame:
    """How well the evidence states the reference claims of its source."""
    rows = table(spark, folder, "reference_claims").where("source_id IS NOT NULL").withColumn("tolerance_ms", F.coalesce("tolerance_ms", F.lit(30_000)))
    columns = ["source_id", "text", "evidence", "timestamp_ms", "tolerance_ms"]
    claims = rows.groupBy("claim_id").agg(F.min(F.struct(*columns)).alias("c")).select("claim_id", "c.*")
    points = _claims(spark, folder).where("source_id IS NOT NULL").select("source_id", F.col("evidence_id").alias("point_id"), "text", F.col("start_ms").alias("timestamp_ms"))
    matches = stage(scoring.best_matches(claims, points), "matches")
    transcripts = table(spark, folder, "transcripts")
    titles = latest(transcripts, ["source_id"], "ingested_at", ["title"]).withColumnRenamed("title", "overview") if "title" in transcripts.columns else None
    return scoring.scores(claims, matches, valid_transcripts(transcripts, ["duration_ms"]), points, titles)


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    made = session_windows(table(spark, folder, "events"), "user_id", "ts", pause="6 hours")
    wall = lambda c: F.unix_micros(F.from_utc_timestamp(F.col(c), F.current_timezone()))  # noqa: E731  events carry no zone
    return made.select("user_id", wall("session_start").alias("start_us"), wall("session_end").alias("end_us"), "events")


def job_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The analysis jobs that the evidence's topics make, with the number of jobs that each waits for."""
    topics = _claims(spark, folder).select("source_id", F.regexp_extract("topic_id", r"^(.*)-topic-\d+\z", 1).alias("chapter_id"), "topic_id")
    jobs, edges = graph.analysis_graph(topics)
    waits = edges.groupBy("job_id").agg(F.count("*").alias("waits"))
    return jobs.join(waits, "job_id", "left").select("source_id", "job_id", "kind", "priority", F.coalesce("waits", F.lit(0)).cast("bigint").alias("waits"))


def reuse_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Later documents that an earlier one of the same source and profile, or with the same text, makes unnecessary."""
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.concat_ws("|", "source_id", "profile").alias("request_key"), F.sha2("text", 256).alias("analysis_key"), (F.col("created_at") < F.to_timestamp(F.lit("2025-07-01T00:00:00Z"))).alias("early"))
    earlier = rows.where("early").select(F.col("doc_id").alias("run_id"), "request_key", "analysis_key")
    return graph.reusable(rows.where("NOT early").select("doc_id", "request_key", "analysis_key"), earlier, "request_key", "analysis_key", "run_id").where("run_id IS NOT NULL").select("doc_id", "run_id", "reused")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        url_identity, source_identities, content_fingerprint, content_dedupe, artifact_usage, clock_labels, safe_names, time_prefixes, clean_cues, half_even_ms, quarter_coverage, row_invariants, vtt_roundtrip,
        json3_roundtrip, topic_packs, source_packs, digest_document, vault_notes, vault_links, json_documents, topic_summaries, retention_compact, retention_private, claim_scores, event_sessions, job_graph, reuse_lookup,
    )
}

_HOSTS = ", ".join(f"'{h}'" for h in identity.VIDEO_HOSTS)
_SHORT = ", ".join(f"'{h}'" for h in identity.SHORT_HOSTS)
_MEDIA = ", ".join(f"'{s}'" for s in identity.MEDIA_SUFFIXES)
_CLOCK = "CASE WHEN {0} // 3600000 > 0 THEN format('{{:02d}}:{{:02d}}:{{:02d}}', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60) ELSE format('{{:02d}}:{{:02d}}', {0} // 60000, {0} // 1000 % 60) END"
_CHAPTERS = """
    ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, chapter_id ORDER BY received_at DESC, ord DESC, title DESC NULLS LAST, start_ms DESC, end_ms DESC NULLS LAST) AS k FROM chapters
           WHERE source_id IS NOT NULL AND chapter_id IS NOT NULL) WHERE k = 1)
"""
_TR = "tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ingested_at DESC, {0}) AS k FROM transcripts WHERE source_id IS NOT NULL) WHERE k = 1)"
_WRITTEN = f"""
    w AS (SELECT source_id, start_ms, end_ms, trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '{tx.SPACE}+', ' ', 'g')) AS text FROM (
          SELECT s.*, row_number() OVER (PARTITION BY s.source_id, seg_idx ORDER BY start_ms, end_ms, text NULLS FIRST, speaker NULLS FIRST) AS k
          FROM segments s SEMI JOIN (SELECT source_id FROM transcripts) t ON t.source_id = s.source_id WHERE seg_idx IS NOT NULL AND start_ms >= 0 AND end_ms > start_ms) WHERE k = 1)
    SELECT source_id, start_ms, end_ms, text FROM w WHERE text <> ''
"""
_CLAIMS = """
    cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY source_id NULLS FIRST, topic_id NULLS FIRST, claim_no NULLS FIRST, text NULLS FIRST, start_ms NULLS FIRST, end_ms NULLS FIRST, provenance NULLS FIRST) AS k FROM evidence WHERE evidence_id IS NOT NULL)
           WHERE k = 1 AND topic_id IS NOT NULL AND source_id IS NOT NULL AND (provenance <> 'source' OR start_ms IS NOT NULL)),
    tp AS (SELECT source_id, regexp_extract(topic_id, '^(.*)-topic-\\d+$', 1) AS chapter_id, topic_id, count(*) AS claims,
           list(struct_pack(evidence := CASE WHEN start_ms IS NULL THEN [] ELSE [struct_pack(end_ms := end_ms, provenance := provenance, start_ms := start_ms, text := text)] END, provenance := provenance, text := text) ORDER BY claim_no NULLS FIRST, evidence_id) AS c
           FROM cl GROUP BY source_id, topic_id),
    fp AS (SELECT *, sha256(CAST(to_json(struct_pack(claims := c, source_id := source_id, topic_id := topic_id)) AS VARCHAR)) AS fingerprint FROM tp)
"""
_NOTES = (
    _CHAPTERS
    + r""",
    n1 AS (SELECT source_id, chapter_id, coalesce(title, '') AS title, start_ms, coalesce(nullif(trim(regexp_replace(coalesce(title, ''), '[\\/:*?"<>|]', '-', 'g'), ' .'), ''), 'note') AS base FROM ch),
    n2 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source_id, base ORDER BY chapter_id) = 1 THEN base ELSE base || '-' || chapter_id END AS name FROM n1)
"""
)
_OBJECTS = """
    d AS (SELECT sha256(text) AS digest, created_at, source_id, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL),
    o AS (SELECT digest, max(created_at) AS m, max(size) AS size FROM d GROUP BY 1),
    x AS (SELECT DISTINCT source_id FROM sources WHERE kind = 'local_media')
"""
_URLS_SQL = rf"""
        WITH u AS (SELECT DISTINCT canonical_url, lower(regexp_extract(trim(canonical_url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host, regexp_extract(trim(canonical_url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM sources WHERE canonical_url IS NOT NULL),
        v AS (SELECT *, CASE WHEN host IN ({_SHORT}) THEN regexp_extract(path, '^/+([^/]+)', 1) WHEN host IN ({_HOSTS}) AND path = '/watch' THEN regexp_extract(trim(canonical_url), '^[^#]*[?&]v=([^&#]*)', 1)
              WHEN host IN ({_HOSTS}) THEN regexp_extract(path, '^/+(?:shorts|embed)/([^/]+)/*$', 1) END AS f FROM u),
        w AS (SELECT *, CASE WHEN regexp_matches(trim(canonical_url), '^(?i:https?)://') AND regexp_matches(f, '^[A-Za-z0-9_-]{{11}}$') THEN f END AS video_id FROM v)
        SELECT canonical_url, host, video_id, 'https://www.youtube.com/watch?v=' || video_id AS canonical,
               NOT regexp_matches(canonical_url, '^(?i:https?):') AND lower(regexp_extract(canonical_url, '[^/\\](\.[^./\\]+)$', 1)) IN ({_MEDIA}) AS is_media FROM w
"""
SQL: dict[str, str] = {
    "url_identity": _URLS_SQL,
    "source_identities": """
        WITH g AS (SELECT source_id, count(*) AS rows, min(kind) AS kind, min(video_id) AS video_id, min(canonical_url) AS url, min(local_path) AS path FROM sources WHERE source_id IS NOT NULL GROUP BY 1)
        SELECT *, (kind = 'youtube' AND coalesce(video_id, '') <> '') OR (kind = 'local_media' AND coalesce(path, '') <> '') AS complete FROM g
    """,
    "content_fingerprint": f"""
        WITH {_TR.format("language DESC NULLS LAST, title DESC NULLS LAST, provenance DESC NULLS LAST, duration_ms DESC NULLS LAST")}
        SELECT source_id, sha256(CAST(to_json(struct_pack(duration_ms := duration_ms, language := language, provenance := provenance, source_id := source_id, title := title)) AS VARCHAR)) AS fingerprint FROM tr
    """,
    "content_dedupe": "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc, substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3) || '.json.zst' AS path FROM documents WHERE text IS NOT NULL GROUP BY 1, 4",
    "artifact_usage": "SELECT count(*) AS files, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)",
    "clock_labels": f"""
        SELECT evidence_id, {_CLOCK.format("s")} AS label, CASE p WHEN 'source' THEN 'Source' WHEN 'ai_explanation' THEN 'AI Explanation' WHEN 'external_research' THEN 'External Research' ELSE p END AS origin
        FROM (SELECT evidence_id, min(start_ms) AS s, min(provenance) AS p FROM evidence WHERE start_ms IS NOT NULL GROUP BY 1)
    """,
    "safe_names": rf"""WITH {_CHAPTERS} SELECT source_id, chapter_id, coalesce(nullif(trim(regexp_replace(title, '[\\/:*?"<>|]', '-', 'g'), ' .'), ''), 'note') AS name, format('part-{{:03d}}', ord) AS part FROM ch""",
    "time_prefixes": r"""
        WITH t AS (SELECT start_ms, regexp_extract(text, '^[\[(<]?(\d+:\d\d(?::\d\d)?(?:[.,]\d+)?)', 1) AS code FROM segments), p AS (SELECT *, string_split(replace(code, ',', '.'), ':') AS l FROM t WHERE code <> '')
        SELECT CAST(len(l) AS INTEGER) AS parts, count(*) AS cues, CAST(sum(abs(CAST(round_even(1000 * list_reduce(list_transform(l, lambda x: CAST(x AS DOUBLE)), lambda a, b: a * 60 + b), 0) AS BIGINT) - start_ms)) AS BIGINT) AS apart_ms FROM p GROUP BY 1
    """,
    "clean_cues": f"SELECT * FROM (SELECT replace(lower(trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '{tx.SPACE}+', ' ', 'g'))), 'ß', 'ss') AS text, count(*) AS cues FROM segments WHERE text IS NOT NULL GROUP BY 1) WHERE cues > 1 AND text <> ''",
    "half_even_ms": "SELECT event_id, CAST(round_even(value * 1000, 0) AS BIGINT) AS ms FROM events",
    "quarter_coverage": f"""
        WITH {_TR.format("duration_ms DESC NULLS LAST")}, c AS (SELECT DISTINCT source_id, claim_id, timestamp_ms FROM reference_claims WHERE timestamp_ms IS NOT NULL)
        SELECT c.source_id, count(DISTINCT least(3, timestamp_ms * 4 // greatest(1, duration_ms))) AS quarters FROM c JOIN tr USING (source_id) WHERE duration_ms IS NOT NULL GROUP BY 1
    """,
    "row_invariants": """
        SELECT 'segments' AS "table", 'end_after_start' AS rule, count(*) AS rows, count(*) FILTER (NOT coalesce(end_ms > start_ms, false)) AS broken FROM segments
        UNION ALL SELECT 'chapters', 'end_after_start', count(*), count(*) FILTER (NOT coalesce(end_ms > start_ms, false)) FROM chapters
        UNION ALL SELECT 'evidence', 'source_claims_have_time', count(*), count(*) FILTER (NOT coalesce(provenance <> 'source' OR start_ms IS NOT NULL, false)) FROM evidence
        UNION ALL SELECT 'transcripts', 'has_duration', count(*), count(*) FILTER (NOT coalesce(duration_ms > 0, false)) FROM transcripts
        UNION ALL SELECT 'sources', 'has_address', count(*), count(*) FILTER (canonical_url IS NULL AND local_path IS NULL) FROM sources
    """,
    "vtt_roundtrip": f"WITH {_WRITTEN}",
    "json3_roundtrip": f"WITH {_WRITTEN}",
    "topic_packs": f"WITH {_CLAIMS} SELECT source_id, chapter_id, topic_id, claims, fingerprint FROM fp",
    "source_packs": f"""
        WITH {_CLAIMS}, {_TR.format("title DESC NULLS LAST")}, p AS (SELECT source_id, count(*) AS topics, CAST(sum(CAST('0x' || substr(fingerprint, 1, 12) AS BIGINT)) AS VARCHAR) AS topic_sum FROM fp GROUP BY 1)
        SELECT p.source_id, title, topics, sha256(CAST(to_json(struct_pack(source_id := p.source_id, title := title, topic_sum := topic_sum, topics := topics)) AS VARCHAR)) AS fingerprint FROM p LEFT JOIN tr USING (source_id)
    """,
    "digest_document": rf"""
        WITH {_CLAIMS}, {_CHAPTERS},
        ln AS (SELECT source_id, topic_id, string_agg('- [' || CASE provenance WHEN 'source' THEN 'Source' WHEN 'ai_explanation' THEN 'AI Explanation' WHEN 'external_research' THEN 'External Research' ELSE provenance END || '] ' || text
               || CASE WHEN start_ms IS NULL THEN '' ELSE ' (' || {_CLOCK.format("start_ms")} || ')' END, chr(10) ORDER BY claim_no NULLS FIRST, evidence_id) AS lines FROM cl GROUP BY 1, 2),
        se AS (SELECT source_id, regexp_extract(topic_id, '^(.*)-topic-\d+$', 1) AS chapter_id, string_agg('### ' || topic_id || chr(10) || chr(10) || lines, chr(10) || chr(10) ORDER BY topic_id) AS body FROM ln GROUP BY 1, 2)
        SELECT se.source_id, se.chapter_id, '## ' || coalesce(nullif(trim(title), ''), se.chapter_id) || chr(10) || chr(10) || body || chr(10) AS document FROM se LEFT JOIN ch USING (source_id, chapter_id)
    """,
    "vault_notes": f"""
        WITH {_NOTES}, u AS (SELECT source_id, min(canonical_url) AS url FROM sources WHERE source_id IS NOT NULL GROUP BY 1)
        SELECT n2.source_id, name || '.md' AS path, '---' || chr(10) || 'source: ' || coalesce(url, '') || chr(10) || 'topic_id: ' || chapter_id || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || 'From ' || {_CLOCK.format("start_ms")} || chr(10) AS content
        FROM n2 LEFT JOIN u USING (source_id)
    """,
    "vault_links": f"WITH {_NOTES} SELECT source_id, chapter_id AS topic_id, '- [[' || name || ']]' AS line FROM n2",
    "json_documents": f"""
        WITH {_TR.format("title DESC NULLS LAST, duration_ms DESC NULLS LAST, provenance DESC NULLS LAST")}
        SELECT source_id, CAST(to_json(struct_pack(duration_ms := duration_ms, provenance := provenance, source_id := source_id, title := title)) AS VARCHAR) AS document FROM tr
    """,
    "retention_compact": f"WITH {_OBJECTS} SELECT digest, 'unreachable_object' AS reason, size FROM o WHERE m < TIMESTAMPTZ '{NOW}' - INTERVAL 7 DAY AND digest NOT IN (SELECT digest FROM d WHERE source_id IS NOT NULL)",
    "retention_private": f"""
        WITH {_OBJECTS} SELECT digest, 'private_after_export' AS reason, size FROM o WHERE digest IN (SELECT digest FROM d WHERE source_id IN (SELECT source_id FROM x))
        AND digest NOT IN (SELECT digest FROM d WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM x))
    """,
    "job_graph": f"""
        WITH e AS (SELECT DISTINCT source_id, regexp_extract(topic_id, '^(.*)-topic-\\d+$', 1) AS c, topic_id AS t FROM (SELECT * FROM evidence WHERE evidence_id IS NOT NULL AND source_id IS NOT NULL AND topic_id IS NOT NULL))
        SELECT source_id, source_id || ':topic:' || t AS job_id, 'topic' AS kind, 20 AS priority, CAST(0 AS BIGINT) AS waits FROM e
        UNION ALL SELECT source_id, source_id || ':chapter:' || c, 'chapter', 10, count(*) FROM e GROUP BY source_id, c
        UNION ALL SELECT source_id, source_id || ':compose', 'compose', 5, count(DISTINCT c) FROM e GROUP BY source_id
    """,
    "reuse_lookup": """
        WITH d AS (SELECT doc_id, concat_ws('|', source_id, profile) AS k, sha256(text) AS a, created_at < TIMESTAMPTZ '2025-07-01T00:00:00Z' AS early FROM documents WHERE text IS NOT NULL),
        x AS (SELECT k, min(doc_id) AS r FROM d WHERE early GROUP BY 1), y AS (SELECT a, min(doc_id) AS r FROM d WHERE early GROUP BY 1)
        SELECT doc_id, coalesce(x.r, y.r) AS run_id, CASE WHEN x.r IS NOT NULL THEN 'request_key' WHEN y.r IS NOT NULL THEN 'analysis_key' END AS reused FROM d LEFT JOIN x USING (k) LEFT JOIN y USING (a) WHERE NOT early AND coalesce(x.r, y.r) IS NOT NULL
    """,
    "event_sessions": """
        WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 21600000000 THEN 0 ELSE 1 END AS f FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM e)
        SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS events FROM g GROUP BY user_id, k
    """,
}
