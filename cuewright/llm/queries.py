"""Queries of this subpackage, by name, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuewright.llm import language, leakage, nearest, packing, splitting, truncation, turns
from cuewright.sources.tables import table
from cuewright.staging import stage


def _p1(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, t) for t in ("segments", "speakers", "transcripts")]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return turns.speaker_turns(*_p1(spark, folder)).select("source_id", "first_seg_idx", "speaker_id")


def p1_turns(spark: SparkSession, folder: str) -> DataFrame:
    segments, speakers, transcripts = _p1(spark, folder)
    return turns.turn_texts(segments, speakers, transcripts, language.languages_of_cues(segments, transcripts))


def p1_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """The mined layouts and what their last slot holds."""
    segments, speakers, _ = _p1(spark, folder)
    made = turns.layouts(segments, speakers)
    return made.select(F.array_join("path", " ").alias("layout"), "n", "people", "times", "follows", "is_speaker", "is_time", F.array_join(F.transform("constants", lambda c: c["word"]), " ").alias("constants"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    claims, evidence = table(spark, folder, "reference_claims"), table(spark, folder, "evidence")
    return nearest.nearest_in_time(claims, evidence, "source_id", "claim_id", "timestamp_ms", "evidence_id", "start_ms", "tolerance_ms").select("claim_id", "evidence_id")


def p3_languages(spark: SparkSession, folder: str) -> DataFrame:
    return language.spoken_languages(table(spark, folder, "segments"), table(spark, folder, "transcripts"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_languages(spark, folder).where("seg_idx >= 0 OR NOT label_agrees").select("source_id", "seg_idx", "language")


def _p5(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_chapters(*[table(spark, folder, t) for t in ("chapters", "transcripts", "segments", "segmentation_policies")])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p5(spark, folder).where("piece = 1").select("policy_id", "source_id", "chapter_id")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _p5(spark, folder)


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), table(spark, folder, "containers"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(p6_packed(spark, folder), table(spark, folder, "containers"))


def p6_checked(spark: SparkSession, folder: str) -> DataFrame:
    sizes, containers = stage(packing.token_counts(table(spark, folder, "documents")), "tokens"), table(spark, folder, "containers")
    return packing.checked(stage(packing.pack(sizes, containers), "packing"), sizes, containers)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("item_id", "doc_id")


def p7_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Each passage that leaked: where it stands in the document, and whether it is an exact phrase."""
    found = leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.select("item_id", "doc_id", "share", "kind", F.posexplode("passages").alias("passage", "p")).select("item_id", "doc_id", "share", "kind", "passage", "p.*")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.judged(table(spark, folder, "documents")).where("truncated").select("doc_id").distinct()


def p8_share(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated_share(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_layouts": p1_layouts, "p1_turns": p1_turns, "p2_found": p2_found, "p3_found": p3_found, "p3_languages": p3_languages, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_packed": p6_packed, "p6_fill": p6_fill, "p6_checked": p6_checked, "p7_found": p7_found, "p7_passages": p7_passages, "p8_found": p8_found, "p8_share": p8_share}

_CLOSED = """
        ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, chapter_id ORDER BY received_at DESC, ord DESC, title DESC, start_ms DESC, end_ms DESC) AS k FROM chapters
              WHERE source_id IS NOT NULL AND chapter_id IS NOT NULL) WHERE k = 1 AND start_ms IS NOT NULL),
        tr AS (SELECT source_id, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ingested_at DESC, duration_ms DESC NULLS LAST) AS k FROM transcripts) WHERE k = 1),
        cl AS (SELECT ch.source_id, chapter_id, start_ms, coalesce(end_ms, lead(start_ms) OVER (PARTITION BY ch.source_id ORDER BY start_ms, ord, chapter_id), duration_ms) AS e FROM ch LEFT JOIN tr USING (source_id))
"""
SQL: dict[str, str] = {
    "p2_found": """
        WITH e AS (SELECT source_id, start_ms, min(evidence_id) AS evidence_id FROM evidence WHERE source_id IS NOT NULL AND start_ms IS NOT NULL GROUP BY 1, 2),
        c AS (SELECT DISTINCT claim_id, source_id, timestamp_ms, coalesce(tolerance_ms, 30000) AS tol FROM reference_claims),
        m AS (SELECT c.claim_id, e.evidence_id, row_number() OVER (PARTITION BY c.claim_id ORDER BY abs(e.start_ms - c.timestamp_ms), e.start_ms) AS k
              FROM c JOIN e ON e.source_id = c.source_id AND e.start_ms BETWEEN c.timestamp_ms - c.tol AND c.timestamp_ms + c.tol)
        SELECT claim_id, evidence_id FROM m WHERE k = 1
    """,
    "p6_checked": "SELECT container_name, (SELECT count(DISTINCT doc_id) FROM documents WHERE length(text) > 0) AS documents, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS divided FROM containers",
    "p5_found": f"WITH {_CLOSED} SELECT policy_id, source_id, chapter_id FROM cl JOIN (SELECT DISTINCT policy_id, maximum_ms FROM segmentation_policies) p ON e - start_ms > maximum_ms",
    "p5_pieces": rf"""
        WITH RECURSIVE {_CLOSED},
        c0 AS (SELECT source_id, seg_idx, start_ms AS x, CASE WHEN end_ms > start_ms THEN end_ms END AS z, regexp_replace(coalesce(text, ''), '<[^>]*>|[\[(][^\])]*[\])]|♪', ' ', 'g') AS p FROM segments
               WHERE start_ms IS NOT NULL AND seg_idx IS NOT NULL AND source_id IN (SELECT source_id FROM tr)),
        c1 AS (SELECT source_id, seg_idx, x, z, regexp_matches(p, '[.!?。！？…][\s"''”’»)\]*]*$') AS s, len(list_filter(regexp_split_to_array(p, '\s+'), lambda v: v <> '')) AS w FROM c0),
        c2 AS (SELECT *, lead(x) OVER (PARTITION BY source_id ORDER BY x, seg_idx) AS nx FROM (SELECT *, row_number() OVER (PARTITION BY source_id, seg_idx ORDER BY x, z NULLS FIRST, s, w) AS k FROM c1) WHERE k = 1),
        c3 AS (SELECT source_id, x, w, CASE WHEN s OR nx - coalesce(z, nx) >= {splitting.PAUSE_MS} THEN coalesce(z, nx) END AS b FROM c2),
        j AS (SELECT policy_id, source_id, chapter_id, start_ms, e, maximum_ms AS lim, greatest(0, least(overlap_ms, maximum_ms - 1)) AS ov FROM cl JOIN (SELECT DISTINCT policy_id, maximum_ms, coalesce(overlap_ms, 0) AS overlap_ms FROM segmentation_policies) p ON e - start_ms > maximum_ms),
        m AS (SELECT j.policy_id, j.source_id, j.chapter_id, list(b) AS bs FROM j JOIN c3 ON c3.source_id = j.source_id AND b >= start_ms AND b < e GROUP BY 1, 2, 3),
        w AS (SELECT j.*, coalesce(bs, []) AS bs, 0 AS piece, start_ms AS a, start_ms AS nxt, start_ms AS z, true AS "natural" FROM j LEFT JOIN m USING (policy_id, source_id, chapter_id)
              UNION ALL SELECT policy_id, source_id, chapter_id, start_ms, e, lim, ov, bs, piece + 1, nxt, CASE WHEN e - nxt <= lim THEN e ELSE coalesce(best, nxt + lim) - ov END, CASE WHEN e - nxt <= lim THEN e ELSE coalesce(best, nxt + lim) END, e - nxt <= lim OR best IS NOT NULL
              FROM (SELECT *, list_max(list_filter(bs, lambda b: b > nxt + ov AND b <= nxt + lim)) AS best FROM w WHERE z < e)),
        pw AS (SELECT policy_id, w.source_id, chapter_id, piece, sum(c3.w) AS words FROM w JOIN c3 ON c3.source_id = w.source_id AND c3.x >= a AND c3.x < z WHERE piece > 0 GROUP BY 1, 2, 3, 4)
        SELECT policy_id, source_id, chapter_id, CAST(piece AS INTEGER) AS piece, a AS start_ms, z AS end_ms, "natural", CAST(coalesce(words, 0) AS BIGINT) AS words FROM w LEFT JOIN pw USING (policy_id, source_id, chapter_id, piece) WHERE piece > 0
    """,
}
