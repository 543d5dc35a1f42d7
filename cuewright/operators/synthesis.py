"""Summaries of topics, chapters and recordings by a pluggable generator, and the packs they make."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cuewright.functions.identity import fingerprint
from cuewright.functions.text import first_filled, unfenced

#: What a generator gets and returns: a text (and what was wrong with the last answer, or None), and an answer.
Generator = Callable[[str, str | None], dict]

ANSWER = "summary string, concepts array<string>"


def extractive(text: str, complaint: str | None = None) -> dict:
    """The default generator: the whole first sentence, which is the whole text where no mark ends one, and the five commonest words of five letters or more. The same text gives the same answer."""
    sentence = re.split(r"(?<=[.!?。！？])\s*", text.strip(), maxsplit=1)[0]
    words = Counter(w for w in re.findall(r"[^\W\d_]{5,}", text.casefold()))
    return {"summary": sentence, "concepts": [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:5]]}


def complaint_about(answer: object) -> str | None:
    """What makes an answer unusable, or None."""
    if not isinstance(answer, dict):
        return "the answer is no object"
    if not isinstance(answer.get("summary"), str) or not answer["summary"].strip():
        return "the summary is missing"
    if not isinstance(answer.get("concepts"), list) or not all(isinstance(c, str) for c in answer["concepts"]):
        return "concepts must be a list of texts"
    return None


def generated(requests: DataFrame, keys: list[str], text: str, generator: Generator = extractive) -> DataFrame:
    """Answers for each row: ``keys, summary, concepts, attempts, error``. An unusable answer gets one repair; a second leaves the error.

    The generator runs on the executors, one Arrow batch after the other; the number of partitions bounds how many run at
    once. Null texts count as empty.
    """
    schema = ", ".join(f"{k} {requests.schema[k].dataType.simpleString()}" for k in keys)

    def answer(value: str) -> tuple[str | None, list[str] | None, int, str | None]:
        complaint, got = None, None
        for attempt in (1, 2):
            try:
                got = generator(value, complaint)
                complaint = complaint_about(got)
            except Exception as error:  # a generator's failure is a row's error, not the job's
                complaint = f"{type(error).__name__}: {error}"
            if complaint is None:
                return got["summary"], got["concepts"], attempt, None
        return None, None, 2, complaint

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [answer(v if isinstance(v, str) else "") for v in b[text].tolist()]
            yield pd.DataFrame({**{k: b[k] for k in keys}, "summary": [m[0] for m in made], "concepts": [m[1] for m in made], "attempts": [m[2] for m in made], "error": [m[3] for m in made]}, index=b.index)

    return requests.select(*keys, text).mapInPandas(run, f"{schema}, {ANSWER}, attempts int, error string")


def repaired_overview(answer: Column) -> Column:
    """The overview of a JSON answer under any of the names that generators use, code fences removed; null if there is none."""
    body = F.from_json(unfenced(answer), "overview STRING, summary STRING, description STRING, text STRING")
    return first_filled(body["overview"], body["summary"], body["description"], body["text"])


def repaired_list(answer: Column, name: str) -> Column:
    """A list of a JSON answer as texts; what is no list is an empty one, null stays for no answer."""
    found = F.try_variant_get(F.try_parse_json(answer), f"$.{name}", "array<string>")
    return F.when(answer.isNotNull(), F.coalesce(found, F.expr("CAST(array() AS array<string>)")))


def topic_requests(topic_cues: DataFrame, cues: DataFrame) -> DataFrame:
    """The text of each topic, its cues in order: ``source_id, topic_id, text``. A topic's length bounds what is collected."""
    each = topic_cues.select("source_id", "topic_id", F.explode("seg_indexes").alias("seg_idx")).join(cues.select("source_id", "seg_idx", "text"), ["source_id", "seg_idx"])
    lines = each.groupBy("source_id", "topic_id").agg(F.sort_array(F.collect_list(F.struct("seg_idx", "text"))).alias("l"))
    return lines.select("source_id", "topic_id", F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"))


def topic_packs(claims: DataFrame) -> DataFrame:
    """Topics with their claims and a fingerprint: ``source_id, chapter_id, topic_id, claims, fingerprint``.

    ``claims``: ``source_id, topic_id, claim_no, evidence_id, text, start_ms, end_ms, provenance``, ids once. A claim
    without a time has no evidence, so one said to come from the source is left out.
    """
    rows = claims.where("topic_id IS NOT NULL AND source_id IS NOT NULL").where("provenance <> 'source' OR start_ms IS NOT NULL")
    evidence = F.when(F.col("start_ms").isNotNull(), F.array(F.struct("end_ms", "provenance", "start_ms", "text"))).otherwise(F.array())
    each = rows.select("source_id", "topic_id", F.struct("claim_no", "evidence_id", F.struct(evidence.alias("evidence"), "provenance", "text").alias("claim")).alias("c"))
    made = each.groupBy("source_id", "topic_id").agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["claim"]).alias("claims"))
    made = made.withColumn("chapter_id", F.regexp_extract("topic_id", r"^(.*)-topic-\d+\z", 1))
    return made.select("source_id", "chapter_id", "topic_id", "claims", fingerprint(claims=F.col("claims"), source_id=F.col("source_id"), topic_id=F.col("topic_id")).alias("fingerprint"))


def source_packs(topics: DataFrame, titles: DataFrame) -> DataFrame:
    """One pack a source: ``source_id, title, topics, fingerprint``.

    It holds the number of its topics and the sum of their fingerprints' first 48 bits, which are combined before the
    shuffle: neither a row nor a task grows with a recording's length.
    """
    part = F.conv(F.substring("fingerprint", 1, 12), 16, 10).cast("decimal(38,0)")
    per = topics.groupBy("source_id").agg(F.count("*").alias("topics"), F.sum(part).cast("string").alias("_sum"))
    both = per.join(titles.select("source_id", "title"), "source_id", "left")
    return both.select("source_id", "title", "topics", fingerprint(source_id=F.col("source_id"), title=F.col("title"), topics=F.col("topics"), topic_sum=F.col("_sum")).alias("fingerprint"))


def composed(sources: DataFrame, keys: list[str], text: str, outline: Generator = extractive, compose: Generator = extractive, verify: Generator = extractive) -> DataFrame:
    """Three passes, each over the last one's answer: ``keys, document, error``. A pass that fails ends its row with its error."""
    first = generated(sources, keys, text, outline)
    second = generated(first.where("error IS NULL").select(*keys, F.concat_ws("\n", "summary", F.array_join("concepts", ", ")).alias(text)), keys, text, compose)
    third = generated(second.where("error IS NULL").select(*keys, F.col("summary").alias(text)), keys, text, verify)
    failed = [d.where("error IS NOT NULL").select(*keys, F.lit(None).cast("string").alias("document"), "error") for d in (first, second)]
    return third.select(*keys, F.col("summary").alias("document"), "error").unionByName(failed[0]).unionByName(failed[1])


def last_message(lines: Column) -> Column:
    """Of a process's JSON lines the text of the last message and the last token counts: ``struct<text, usage>``."""
    event = "type STRING, item STRUCT<type: STRING, text: STRING>, usage MAP<STRING, BIGINT>"
    events = F.transform(F.split(lines, "\n"), lambda x: F.from_json(x, event))
    texts = F.filter(events, lambda e: (e["item"]["type"] == "agent_message") & e["item"]["text"].isNotNull())
    usages = F.filter(events, lambda e: F.coalesce(F.size(e["usage"]), F.lit(-1)) > 0)
    return F.struct(F.try_element_at(texts, F.lit(-1))["item"]["text"].alias("text"), F.try_element_at(usages, F.lit(-1))["usage"].alias("usage"))
