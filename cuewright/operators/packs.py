"""Packs of knowledge: topics reduced to chapters, chapters to recordings, and the documents that show them.

A recording's pack comes as one row for itself and one for each chapter, so that no row grows with its length; written in
order of ``part`` they are its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuewright.functions.identity import fingerprint
from cuewright.functions.text import clock, provenance_label
from cuewright.operators.documents import named_notes
from cuewright.operators.ordered import join_one
from cuewright.operators.synthesis import Generator, extractive, generated
from cuewright.staging import stage

#: Texts that a generator reads at once; more are reduced in several rounds.
FAN = 64


def reduced(rows: DataFrame, keys: list[str], order: str, text: str, generator: Generator = extractive, fan: int = FAN) -> DataFrame:
    """One answer for all texts of a key, in order: ``keys, summary, error``.

    Groups of ``fan`` texts are answered, then groups of those answers, until each key has one; so no request and no row
    grows with a key's rows. Texts that are null count as empty; an answer that failed leaves its group out.
    """
    marked = rows.select(*keys, F.coalesce(text, F.lit("")).alias("_text"), F.struct(order).alias("_order"))
    # groups are told by hashes: ranks would put whole keys in order
    sizes = marked.groupBy(*keys).count()
    most = sizes.agg(F.max("count")).first()[0] or 0
    level = marked
    while True:
        groups = -(-most // fan)
        if groups > 1:
            level = level.join(sizes, keys).withColumn("_group", F.pmod(F.xxhash64("_order"), F.ceil(F.col("count") / fan)).cast("bigint")).drop("count")
        else:
            level = level.withColumn("_group", F.lit(0).cast("bigint"))
        lines = level.groupBy(*keys, "_group").agg(F.sort_array(F.collect_list(F.struct("_order", "_text"))).alias("l"))
        joined = lines.select(*keys, "_group", F.array_min("l")["_order"].alias("_order"), F.array_join(F.transform("l", lambda x: x["_text"]), " ").alias("_text"))
        made = stage(generated(joined.select(*keys, "_group", "_text"), [*keys, "_group"], "_text", generator), "reduced")
        if groups <= 1:
            return made.select(*keys, "summary", "error")
        level = made.where("error IS NULL").join(joined.select(*keys, "_group", "_order"), [*keys, "_group"]).select(*keys, F.col("summary").alias("_text"), "_order")
        sizes = level.groupBy(*keys).count()
        most = sizes.agg(F.max("count")).first()[0] or 0


def summarized_topics(topics: DataFrame) -> DataFrame:
    """Topic packs with a title and a summary where the generator gave none: the id, and the first claim."""
    first = F.try_element_at("claims", F.lit(1))["text"]
    return topics.select("source_id", "chapter_id", "topic_id", F.col("topic_id").alias("title"), F.coalesce(first, F.lit("")).alias("summary"), "claims", F.col("fingerprint").alias("topic_fingerprint"))


def chapter_packs(topics: DataFrame, chapters: DataFrame, generator: Generator = extractive) -> DataFrame:
    """The chapter stage: ``source_id, chapter_id, title, summary, topic_ids, topics, fingerprint``.

    ``topics``: ``source_id, chapter_id, topic_id, title, summary, claims, topic_fingerprint``; ``chapters``: ``source_id,
    chapter_id, title``. The summary is the generator's of its topics' summaries. Topics of one chapter are one row.
    """
    made = reduced(topics, ["source_id", "chapter_id"], "topic_id", "summary", generator).select("source_id", "chapter_id", F.coalesce("summary", F.lit("")).alias("summary"))
    held = topics.groupBy("source_id", "chapter_id").agg(F.sort_array(F.collect_list(F.struct("topic_id", "title", "summary", "claims", "topic_fingerprint"))).alias("topics"))
    both = held.join(made, ["source_id", "chapter_id"], "left").join(chapters.select("source_id", "chapter_id", F.nullif(F.trim("title"), F.lit("")).alias("_title")), ["source_id", "chapter_id"], "left")
    rows = both.select("source_id", "chapter_id", F.coalesce("_title", "chapter_id").alias("title"), "summary", F.transform("topics", lambda t: t["topic_id"]).alias("topic_ids"), "topics")
    prints = F.transform("topics", lambda t: t["topic_fingerprint"])
    return rows.withColumn("fingerprint", fingerprint(chapter_id=F.col("chapter_id"), source_id=F.col("source_id"), summary=F.col("summary"), title=F.col("title"), topics=prints))


def knowledge_packs(chapters: DataFrame, transcripts: DataFrame, generator: Generator = extractive) -> DataFrame:
    """The whole of each source: ``source_id, title, language, overview, transcript_fingerprint, chapters, topics, fingerprint``.

    ``transcripts``: one row a source with ``title, language, transcript_fingerprint``. The overview is the generator's
    of the chapters' summaries; the fingerprint covers the chapters' by the sum of their first 48 bits, which is combined
    before the shuffle.
    """
    part = F.conv(F.substring("fingerprint", 1, 12), 16, 10).cast("decimal(38,0)")
    per = chapters.groupBy("source_id").agg(F.count("*").alias("chapters"), F.sum(F.size("topic_ids")).alias("topics"), F.sum(part).cast("string").alias("_sum"))
    over = reduced(chapters, ["source_id"], "chapter_id", "summary", generator).select("source_id", F.coalesce("summary", F.lit("")).alias("overview"))
    both = per.join(over, "source_id", "left").join(transcripts, "source_id", "left")
    whole = fingerprint(chapter_sum=F.col("_sum"), chapters=F.col("chapters"), language=F.col("language"), overview=F.col("overview"), source_id=F.col("source_id"), title=F.col("title"), topics=F.col("topics"), transcript_fingerprint=F.col("transcript_fingerprint"))
    return both.select("source_id", "title", "language", "overview", "transcript_fingerprint", "chapters", "topics", whole.alias("fingerprint"))


def _title(title: Column, otherwise: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), otherwise)


def digest_parts(packs: DataFrame, chapters: DataFrame) -> DataFrame:
    """A Markdown digest of each pack: ``source_id, part, document``; part ``''`` has title and overview, the others are chapters by id.

    A claim's line has its origin and, with evidence, its time.
    """
    head = packs.select("source_id", F.lit("").alias("part"), F.concat(F.lit("# "), _title(F.col("title"), F.col("source_id")), F.lit("\n\n"), "overview", F.lit("\n")).alias("document"))
    first = lambda c: F.try_element_at(c["evidence"], F.lit(1))["start_ms"]
    line = lambda c: F.concat(F.lit("- ["), provenance_label(c["provenance"]), F.lit("] "), c["text"], F.when(first(c).isNotNull(), F.concat(F.lit(" ("), clock(first(c)), F.lit(")"))).otherwise(F.lit("")))
    topic = lambda t: F.concat(F.lit("### "), t["title"], F.lit("\n\n"), t["summary"], F.lit("\n\n"), F.array_join(F.transform(t["claims"], line), "\n"))
    body = F.concat(F.lit("\n## "), "title", F.lit("\n\n"), "summary", F.lit("\n\n"), F.array_join(F.transform("topics", topic), "\n\n"), F.lit("\n"))
    return head.unionByName(chapters.select("source_id", F.col("chapter_id").alias("part"), body.alias("document")))


def vault_files(packs: DataFrame, topics: DataFrame, urls: DataFrame) -> DataFrame:
    """A vault of each pack: ``source_id, path, part, content``; one file a topic, and ``index.md`` in parts.

    Part ``''`` of the index has title and overview, the others the links to a chapter's topics, in order of their ids.
    Topics of one title get their id added to the name, but for the first.
    """
    where = urls.select("source_id", "canonical_url")
    head = lambda *more: F.concat(F.lit("---\nsource: "), F.coalesce("canonical_url", F.lit("")), *more, F.lit("\n---\n\n# "))
    named = stage(named_notes(topics.select("source_id", "chapter_id", "topic_id", "title", "summary")), "named")
    notes = join_one(named, where, "source_id", "topic_id").select("source_id", F.concat("name", F.lit(".md")).alias("path"), F.lit("").alias("part"), F.concat(head(F.lit("\ntopic_id: "), F.col("topic_id")), "title", F.lit("\n\n"), "summary", F.lit("\n")).alias("content"))
    top = packs.join(where, "source_id", "left").select("source_id", F.lit("index.md").alias("path"), F.lit("").alias("part"), F.concat(head(), _title(F.col("title"), F.col("source_id")), F.lit("\n\n"), "overview", F.lit("\n\n## Topics\n\n")).alias("content"))
    links = named.groupBy("source_id", "chapter_id").agg(F.sort_array(F.collect_list(F.struct("topic_id", "name"))).alias("l"))
    index = links.select("source_id", F.lit("index.md").alias("path"), F.col("chapter_id").alias("part"), F.concat(F.array_join(F.transform("l", lambda x: F.concat(F.lit("- [["), x["name"], F.lit("]]"))), "\n"), F.lit("\n")).alias("content"))
    return notes.unionByName(top).unionByName(index)
