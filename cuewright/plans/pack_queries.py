"""Queries over packs and their documents, answers of generators, stores and caches, caption sources and identities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuewright import telemetry
from cuewright.functions import identity, text as tx
from cuewright.operators import documents as docs, packs, synthesis
from cuewright.plans import document_queries as dq
from cuewright.sources import artifacts, captions
from cuewright.sources.tables import table, valid_chapters, valid_transcripts
from cuewright.staging import stage, staged_at


def _topics(spark: SparkSession, folder: str) -> DataFrame:
    return stage(packs.summarized_topics(synthesis.topic_packs(dq._claims(spark, folder))), "topics")


def _chapters(spark: SparkSession, folder: str, topics: DataFrame) -> DataFrame:
    return stage(packs.chapter_packs(topics, valid_chapters(table(spark, folder, "chapters"))), "chapters")


def _packs(spark: SparkSession, folder: str, chapters: DataFrame) -> DataFrame:
    rows = valid_transcripts(table(spark, folder, "transcripts"), ["language", "title", "provenance", "duration_ms"])
    known = rows.select("source_id", "title", "language", identity.fingerprint(source_id=F.col("source_id"), language=F.col("language"), title=F.col("title"), provenance=F.col("provenance"), duration_ms=F.col("duration_ms")).alias("transcript_fingerprint"))
    return packs.knowledge_packs(chapters, known)


def chapter_packs(spark: SparkSession, folder: str) -> DataFrame:
    made = _chapters(spark, folder, _topics(spark, folder))
    return made.select("source_id", "chapter_id", "title", "summary", F.array_join("topic_ids", ",").alias("topic_ids"), "fingerprint")


def knowledge_packs(spark: SparkSession, folder: str) -> DataFrame:
    return _packs(spark, folder, _chapters(spark, folder, _topics(spark, folder)))


def pack_digest(spark: SparkSession, folder: str) -> DataFrame:
    chapters = _chapters(spark, folder, _topics(spark, folder))
    return packs.digest_parts(_packs(spark, folder, chapters), chapters)


def pack_vault(spark: SparkSession, folder: str) -> DataFrame:
    topics = _topics(spark, folder)
    urls = table(spark, folder, "sources").where("source_id IS NOT NULL").groupBy("source_id").agg(F.min("canonical_url").alias("canonical_url"))
    return packs.vault_files(_packs(spark, folder, _chapters(spark, folder, topics)), topics, urls)


def store_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts put into a new store twice and read back, those whose content isn't what their digest says told apart."""
    at = staged_at(spark, "store")
    texts = table(spark, folder, "documents").select(F.col("text").alias("json"))
    artifacts.put(texts, at)
    artifacts.put(texts, at)
    held = artifacts.get(spark, at)
    spoiled = held.where("digest >= '8'").unionByName(held.where("digest < '8'").withColumn("json", F.concat("json", F.lit("!"))))
    good, bad = artifacts.checked(spoiled)
    return good.select("digest", F.lit(True).alias("whole"), "size").unionByName(bad.join(held, "digest").select("digest", F.lit(False).alias("whole"), "size"))


def output_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Later documents whose source and profile have an earlier one are taken from it, unless its path leaves its folder."""
    rows = table(spark, folder, "documents").where("text IS NOT NULL AND source_id IS NOT NULL").select(F.concat_ws("|", "source_id", "profile").alias("cache_key"), "doc_id", "text", (F.col("created_at") < F.to_timestamp(F.lit("2025-07-01T00:00:00Z"))).alias("early"))
    path = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("../"), "doc_id")).when(F.col("doc_id") % 10 == 1, F.concat(F.lit("/"), "doc_id")).otherwise(F.concat(F.lit("d/"), "doc_id"))
    cache = rows.where("early").groupBy("cache_key").agg(F.min_by(F.struct(path.alias("path"), F.sha2("text", 256).alias("document")), "doc_id").alias("c")).select("cache_key", "c.*")
    found, missing = docs.cached(rows.where("NOT early").select("cache_key", "doc_id"), cache)
    return found.select("doc_id", "path", "document").unionByName(missing.select("doc_id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("document")))


def transcript_cache(spark: SparkSession, folder: str) -> DataFrame:
    """For every source the transcript in English that is stored of it, if any: the one ingested last."""
    rows = table(spark, folder, "transcripts").where("source_id IS NOT NULL").withColumn("base", tx.language_base(F.trim("language")))
    one = rows.where("base = 'en'").groupBy("source_id").agg(F.max(F.struct("ingested_at", "title", "provenance")).alias("t"))
    return rows.select("source_id").distinct().join(one, "source_id", "left").select("source_id", "t.title", "t.provenance")


def repaired_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers in code fences with the overview under any of its names; lists that aren't, read as none."""
    t = table(spark, folder, "documents").where("doc_id IS NOT NULL AND profile IS NOT NULL")
    name = F.when(F.col("doc_id") % 5 == 0, "overview").when(F.col("doc_id") % 5 == 1, "summary").when(F.col("doc_id") % 5 == 2, "description").otherwise("text")
    fields = F.concat(F.lit('{"'), name, F.lit('": "'), "profile", F.lit('", "further_study": '), F.when(F.col("doc_id") % 2 == 0, F.lit('["a", 2]')).otherwise(F.lit('"a"')), F.lit("}"))
    answer = F.when(F.col("doc_id") % 7 == 0, F.lit("[1, 2]")).when(F.col("doc_id") % 3 == 0, fields).otherwise(F.concat(F.lit("```json\n"), fields, F.lit("\n```")))
    rows = t.select("doc_id", answer.alias("answer"))
    object_ = tx.json_object(F.col("answer"))
    return rows.select("doc_id", object_.isNotNull().alias("is_object"), synthesis.repaired_overview(object_).alias("overview"), F.array_join(synthesis.repaired_list(object_, "further_study"), ",").alias("further_study"))


def last_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The last message and token count of a process's JSON lines, one a user."""
    e = table(spark, folder, "events")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit('{"type": "turn.completed", "usage": {"tokens": '), "event_id", F.lit("}}"))).when(F.col("event_type") == "view", F.lit("no json")).otherwise(
        F.concat(F.lit('{"type": "item.completed", "item": {"type": "'), F.when(F.col("event_type") == "click", "agent_message").otherwise("other"), F.lit('", "text": "m'), "event_id", F.lit('"}}')))
    logs = e.select(F.concat_ws("-", "user_id", F.to_date("ts")).alias("log"), F.struct("event_id", line.alias("x")).alias("l")).groupBy("log").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda l: l["x"]), "\n").alias("lines"))
    last = synthesis.last_message(F.col("lines"))
    return logs.select("log", last["text"].alias("text"), F.try_element_at(last["usage"], F.lit("tokens")).cast("string").alias("tokens"))


def snippet_cues(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence as an interface gives captions: text, start and length in seconds."""
    rows = table(spark, folder, "evidence").where("source_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms > start_ms")
    return captions.snippet_cues(rows.select("source_id", "text", (F.col("start_ms") / 1000).alias("start"), ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("duration")))


def listed_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters out of a recording's metadata, untitled ones numbered by their place in the list."""
    rows = valid_chapters(table(spark, folder, "chapters")).where("start_ms IS NOT NULL")
    item = F.struct(F.col("title"), (F.col("start_ms") / 1000).alias("start_time"), (F.col("end_ms") / 1000).alias("end_time"))
    infos = rows.groupBy("source_id", F.floor(F.col("start_ms") / 36_000_000).alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "ord", "chapter_id", item.alias("i")))), lambda x: x["i"]).alias("chapters"))
    return captions.listed_chapters(infos.withColumn("source_id", F.concat_ws("#", "source_id", "k")))


def source_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Every address and path as the source it stands for."""
    s = table(spark, folder, "sources")
    values = s.select(F.col("canonical_url").alias("value")).union(s.select("local_path")).where("value IS NOT NULL").distinct()
    made = identity.source_identity(F.col("value"), F.sha2("value", 256))
    return values.select("value", made["kind"].alias("kind"), made["source_id"].alias("source_id"), made["canonical_url"].alias("canonical_url"))


def span_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Events as spans that last their value in milliseconds: number, errors and longest by name."""
    rows = table(spark, folder, "events").select(F.col("event_type").alias("name"), F.lit(0.0).alias("start_s"), (F.col("value") / 1000).alias("end_s"), F.when(F.col("user_id") % 4 == 0, "error").otherwise("ok").alias("status"))
    return telemetry.summary(rows).select("name", "spans", "errors", F.round("longest_ms", 3).alias("longest_ms"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (chapter_packs, knowledge_packs, pack_digest, pack_vault, store_roundtrip, output_cache, transcript_cache, repaired_answers, last_messages, snippet_cues, listed_chapters, source_resolve, span_summary)
}

_FIRST = "coalesce(nullif(regexp_extract(trim({0}), '^((?s:.)*?[.!?。！？])', 1), ''), trim({0}))"
_PACKS = rf"""
    {dq._CLAIMS}, {dq._CHAPTERS}, {dq._TR.format("language DESC NULLS LAST, title DESC NULLS LAST, provenance DESC NULLS LAST, duration_ms DESC NULLS LAST")},
    tt AS (SELECT fp.*, arg_min(cl.text, (coalesce(cl.claim_no, -1), cl.evidence_id)) AS summary, string_agg('- [' || CASE cl.provenance WHEN 'source' THEN 'Source' WHEN 'ai_explanation' THEN 'AI Explanation' WHEN 'external_research' THEN 'External Research' ELSE cl.provenance END || '] ' || cl.text
           || CASE WHEN cl.start_ms IS NULL THEN '' ELSE ' (' || {dq._CLOCK.format("cl.start_ms")} || ')' END, chr(10) ORDER BY cl.claim_no NULLS FIRST, cl.evidence_id) AS lines
           FROM fp JOIN cl ON cl.source_id = fp.source_id AND cl.topic_id = fp.topic_id GROUP BY ALL),
    c1 AS (SELECT source_id, chapter_id, string_agg(summary, ' ' ORDER BY topic_id) AS t, string_agg(topic_id, ',' ORDER BY topic_id) AS topic_ids, list(fingerprint ORDER BY topic_id) AS prints, count(*) AS n,
           string_agg('### ' || topic_id || chr(10) || chr(10) || summary || chr(10) || chr(10) || lines, chr(10) || chr(10) ORDER BY topic_id) AS body FROM tt GROUP BY 1, 2),
    c2 AS (SELECT c1.source_id, c1.chapter_id, coalesce(nullif(trim(title), ''), c1.chapter_id) AS title, {_FIRST.format("t")} AS summary, topic_ids, prints, n, body FROM c1 LEFT JOIN ch ON ch.source_id = c1.source_id AND ch.chapter_id = c1.chapter_id),
    c3 AS (SELECT *, sha256(CAST(to_json(struct_pack(chapter_id := chapter_id, source_id := source_id, summary := summary, title := title, topics := prints)) AS VARCHAR)) AS fingerprint FROM c2),
    k1 AS (SELECT source_id, count(*) AS chapters, CAST(sum(n) AS BIGINT) AS topics, CAST(sum(CAST('0x' || substr(fingerprint, 1, 12) AS BIGINT)) AS VARCHAR) AS chapter_sum, string_agg(summary, ' ' ORDER BY chapter_id) AS t FROM c3 GROUP BY 1),
    k2 AS (SELECT k1.source_id, title, language, {_FIRST.format("t")} AS overview, CASE WHEN tr.source_id IS NOT NULL THEN sha256(CAST(to_json(struct_pack(duration_ms := duration_ms, language := language, provenance := provenance, source_id := tr.source_id, title := title)) AS VARCHAR)) END AS transcript_fingerprint,
           chapters, topics, chapter_sum FROM k1 LEFT JOIN tr ON tr.source_id = k1.source_id)
"""
SQL: dict[str, str] = {
    "chapter_packs": f"WITH {_PACKS} SELECT source_id, chapter_id, title, summary, topic_ids, fingerprint FROM c3",
    "knowledge_packs": f"""
        WITH {_PACKS} SELECT source_id, title, language, overview, transcript_fingerprint, chapters, topics, sha256(CAST(to_json(struct_pack(chapter_sum := chapter_sum, chapters := chapters, language := language, overview := overview,
        source_id := source_id, title := title, topics := topics, transcript_fingerprint := transcript_fingerprint)) AS VARCHAR)) AS fingerprint FROM k2
    """,
    "pack_digest": f"""
        WITH {_PACKS} SELECT source_id, '' AS part, '# ' || coalesce(nullif(trim(title), ''), source_id) || chr(10) || chr(10) || overview || chr(10) AS document FROM k2
        UNION ALL SELECT source_id, chapter_id, chr(10) || '## ' || title || chr(10) || chr(10) || summary || chr(10) || chr(10) || body || chr(10) FROM c3
    """,
    "pack_vault": f"""
        WITH {_PACKS}, u AS (SELECT source_id, coalesce(min(canonical_url), '') AS url FROM sources WHERE source_id IS NOT NULL GROUP BY 1)
        SELECT tt.source_id, topic_id || '.md' AS path, '' AS part, '---' || chr(10) || 'source: ' || coalesce(url, '') || chr(10) || 'topic_id: ' || topic_id || chr(10) || '---' || chr(10) || chr(10) || '# ' || topic_id || chr(10) || chr(10) || summary || chr(10) AS content FROM tt LEFT JOIN u USING (source_id)
        UNION ALL SELECT k2.source_id, 'index.md', '', '---' || chr(10) || 'source: ' || coalesce(url, '') || chr(10) || '---' || chr(10) || chr(10) || '# ' || coalesce(nullif(trim(title), ''), k2.source_id) || chr(10) || chr(10) || overview || chr(10) || chr(10) || '## Topics' || chr(10) || chr(10) FROM k2 LEFT JOIN u USING (source_id)
        UNION ALL SELECT source_id, 'index.md', chapter_id, string_agg('- [[' || topic_id || ']]', chr(10) ORDER BY topic_id) || chr(10) FROM tt GROUP BY source_id, chapter_id
    """,
    "store_roundtrip": "SELECT DISTINCT sha256(text) AS digest, sha256(text) >= '8' AS whole, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL",
    "output_cache": """
        WITH d AS (SELECT concat_ws('|', source_id, profile) AS k, doc_id, text, created_at < TIMESTAMPTZ '2025-07-01T00:00:00Z' AS early FROM documents WHERE text IS NOT NULL AND source_id IS NOT NULL),
        c AS (SELECT k, min(doc_id) AS d, sha256(arg_min(text, doc_id)) AS document FROM d WHERE early GROUP BY 1 HAVING min(doc_id) % 10 > 1)
        SELECT doc_id, 'd/' || c.d AS path, document FROM d LEFT JOIN c USING (k) WHERE NOT early
    """,
    "transcript_cache": """
        WITH t AS (SELECT *, split_part(lower(trim(language)), '-', 1) AS base FROM transcripts WHERE source_id IS NOT NULL),
        m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ingested_at DESC, title DESC NULLS LAST, provenance DESC NULLS LAST) AS k FROM t WHERE base = 'en') WHERE k = 1)
        SELECT s.source_id, title, provenance FROM (SELECT DISTINCT source_id FROM t) s LEFT JOIN m USING (source_id)
    """,
    "repaired_answers": """
        SELECT doc_id, doc_id % 7 <> 0 AS is_object, CASE WHEN doc_id % 7 <> 0 THEN nullif(profile, '') END AS overview, CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'a,2' ELSE '' END END AS further_study
        FROM documents WHERE doc_id IS NOT NULL AND profile IS NOT NULL
    """,
    "last_messages": """
        SELECT concat_ws('-', user_id, CAST(ts AS DATE)) AS log, 'm' || max(event_id) FILTER (event_type = 'click') AS text, CAST(max(event_id) FILTER (event_type = 'error') AS VARCHAR) AS tokens FROM events GROUP BY 1
    """,
    "snippet_cues": """
        SELECT source_id, CAST(round_even(start_ms / 1000 * 1000, 0) AS BIGINT) AS start_ms, CAST(round_even((start_ms / 1000 + (end_ms - start_ms) / 1000) * 1000, 0) AS BIGINT) AS end_ms, trim(text) AS text FROM evidence
        WHERE source_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms > start_ms AND trim(text) <> ''
    """,
    "listed_chapters": f"""
        WITH {dq._CHAPTERS}, n AS (SELECT *, start_ms // 36000000 AS g, row_number() OVER (PARTITION BY source_id, start_ms // 36000000 ORDER BY start_ms, ord NULLS FIRST, chapter_id) AS n FROM ch WHERE start_ms IS NOT NULL)
        SELECT source_id || '#' || g AS source_id, CAST(n AS INTEGER) AS ord, format('youtube-{{:03d}}', n) AS chapter_id, coalesce(nullif(title, ''), 'Chapter ' || n) AS title, start_ms, end_ms FROM n WHERE end_ms > start_ms
    """,
    "source_resolve": f"""
        WITH u AS ({dq._URLS_SQL}), v AS (SELECT DISTINCT value FROM (SELECT canonical_url AS value FROM sources UNION ALL SELECT local_path FROM sources) WHERE value IS NOT NULL)
        SELECT value, CASE WHEN video_id IS NOT NULL THEN 'youtube' WHEN m THEN 'local_media' END AS kind, CASE WHEN video_id IS NOT NULL THEN 'youtube:' || video_id WHEN m THEN 'local:' || sha256(value) END AS source_id,
               CASE WHEN video_id IS NOT NULL THEN 'https://www.youtube.com/watch?v=' || video_id END AS canonical_url
        FROM (SELECT value, video_id, NOT regexp_matches(value, '^(?i:https?):') AND lower(regexp_extract(value, '[^/\\\\](\\.[^./\\\\]+)$', 1)) IN ({dq._MEDIA}) AS m FROM v LEFT JOIN u ON u.canonical_url = value)
    """,
    "span_summary": "SELECT event_type AS name, count(*) AS spans, count(*) FILTER (user_id % 4 = 0) AS errors, round(max(value), 3) AS longest_ms FROM events GROUP BY 1",
}
