"""Texts that lost their end: what stops where the same words go on everywhere else."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cuewright.staging import stage

#: A word that ends a sentence or line in fewer of its occurrences than this can't end a text. The rate is that of its own
#: occurrences and of so many average ones.
RARELY, AVERAGE = 0.03, 1.5
#: A word that ends one in at least this share of its occurrences, and of so many more that don't, may do so without punctuation anywhere.
USUALLY, DOUBTS = 0.6, 12
#: A word is a piece of longer ones if for each of its own occurrences at least so many begin with it.
PIECE = 500
#: Characters of the prefix by which texts first meet their longer copies; shorter ones meet them by all of theirs.
HEAD = 32
#: Of shorter texts that long a stretch must follow alike in all longer ones: what goes on differently is a common beginning, no copy.
GOES_ON = 16
#: Letters of prefixes of words that are listed; longer ones are compared with the words that share so many.
LISTED = 40
#: Keys that one task counts before it passes its counts on.
HELD = 300_000
#: A field limit: this share of a source's texts without their end, of those of lengths around it, have this length, more than
#: by chance (so many deviations), and this share with those of lengths near by (a cut may go back to a word's end).
LIMIT_EACH, LIMIT_SHARE, LIMIT_NEAR, LIMIT_AROUND, DEVIATIONS = 0.1, 0.6, 6, 60, 1.5

_CJK = "぀-ヿ㐀-䶿一-鿿々ー"
_TOKEN = re.compile(rf"[{_CJK}]+|[^\W_{_CJK}]+")
_WORDS = re.compile(r"\w+")
_WORDS_BESIDE = re.compile(rf"[^\W{_CJK}]+")
_ANY_CJK = re.compile(f"[{_CJK}]")
_RUNS = re.compile(rf"[{_CJK}]{{2,}}")
_PIECE = re.compile(r"([.!?。！？…]+|\n)")
_FROM_BEHIND = re.compile(r"\W*(\w+)")
_ENDED = re.compile(r"(?<![.。])[.!?。！？][\"'”’»」』)\]*_ ]*$")
_DOTS = re.compile(r"(?:[.。]{2,}|…+)[\"'”’»」』)\]*_ ]*$")
_ITEM_NUMBER = re.compile(r"(?:^|\n)[ \t]*\d{1,4}[.)]$")
_OPEN = re.compile(r"\[[^\[\]\n]*$|<[a-zA-Z/][^<>\n]*$")
# what may follow a finished text: addresses, tags, a signature, a time, sound descriptions
_TRAILER = re.compile(r"(?:\s+(?:https?://\S+|#\w+|(?:—|–|--) [^\n.!?]{1,40}|\[\[[^\[\]\n]{1,80}\]\]|\[[^\[\]\n]{1,40}\]|\([^()\n]{1,40}\)|\*[^*\n]{1,40}\*|♪[^♪\n]*♪|♪+))+$")
# Names of the entities that text exports use.
_ENTITIES = ("amp", "lt", "gt", "quot", "apos", "nbsp", "hellip", "mdash", "ndash", "lsquo", "rsquo", "ldquo", "rdquo", "shy", "bull", "copy", "euro")
_ENTITY = re.compile(r"&(#[xX]?[0-9a-fA-F]*|[a-zA-Z]{0,6})$")


def _trailer(body: str) -> re.Match | None:
    """What follows a finished text, however long; looked for from behind, in stretches that double."""
    if "\n" not in body and body[-1] not in ")]*♪":
        return None
    size = 512
    while True:
        lo = max(0, len(body) - size)
        m = _TRAILER.search(body, lo)
        inside = m is not None and m.start() > lo + size // 2
        plain = m is None and any(c.isspace() for c in body[lo : lo + size // 2])
        if lo == 0 or inside or plain:
            return m
        size *= 2


def ending(text: str) -> tuple[str, str | None, str | None, int]:
    """How a text ends: (state, key, wider key, where its last word begins).

    States: ``empty``; ``ended`` by punctuation; ``cut`` within a character, entity, tag, link or list number;
    ``open`` otherwise, and ``dots`` if dots stand after the last word. The keys are the last word, or of scripts without
    spaces the last three and two characters.
    """
    body = text.rstrip().rstrip("​﻿").rstrip()
    if not body:
        return "empty", None, None, 0
    trailer = _trailer(body)
    if trailer and body[: trailer.start()].strip():
        body = body[: trailer.start()].rstrip()
    if body.endswith("�") or _OPEN.search(body) or _ITEM_NUMBER.search(body):
        return "cut", None, None, len(body)
    m = _ENTITY.search(body)
    if m and (m[1][:1] == "#" or any(e.startswith(m[1]) for e in _ENTITIES)):
        return "cut", None, None, m.start()
    if _ENDED.search(body):
        return "ended", None, None, len(body)
    dots = _DOTS.search(body)
    rest = body[: dots.start()] if dots else body
    last = _TOKEN.search(rest[::-1])  # tokens are runs of one kind of sign, so the first from behind is the last
    if last is None:
        return ("dots" if dots else "open"), None, None, len(rest)
    word = last[0][::-1].casefold()
    at = len(rest) - last.end()
    if _RUNS.fullmatch(word) or (len(word) == 1 and re.fullmatch(f"[{_CJK}]", word)):
        return ("dots" if dots else "open"), word[-3:], word[-2:], at
    return ("dots" if dots else "open"), word, None, at


def count_ends(text: str, ends: Counter, total: Counter) -> int:
    """Add each word's occurrences, and those before punctuation or a line's end; of scripts without spaces, of two and three characters.

    Returns the number of sentences that punctuation ends.
    """
    text = text.casefold()
    cjk = _ANY_CJK.search(text) is not None
    total.update((_WORDS_BESIDE if cjk else _WORDS).findall(text))
    if cjk:
        for r in _RUNS.findall(text):
            total.update(map(str.__add__, r, r[1:]))
            total.update(map("".join, zip(r, r[1:], r[2:])))
    pieces = _PIECE.split(text)
    stops, last = 0, []
    for piece, mark in zip(pieces[::2], pieces[1::2]):
        m = _FROM_BEHIND.match(piece[::-1])
        if m and not (m[1].isdigit() and len(piece) < 8):  # the number of a list's item ends nothing
            last.append(m[1][::-1])
            stops += mark != "\n"
    if cjk:
        runs = [w for w in last if _ANY_CJK.match(w[-1])]
        ends.update(w[-2:] for w in runs if len(w) > 1 and _ANY_CJK.match(w[-2]))
        ends.update(w[-3:] for w in runs if _RUNS.fullmatch(w[-3:]) and len(w) > 2)
        last = [w for w in last if not _ANY_CJK.match(w[-1])]
    ends.update(last)
    return stops


def _sentence_like(text: str) -> bool:
    """Whether the last line has several words and is no item of a list: where nothing else shows how a text marks its sentences, it should end in a mark."""
    last = text.rstrip().rpartition("\n")[2].lstrip()
    return not last.startswith(("- ", "* ", "• ", "+ ")) and (len(last.split()) >= 4 or len(_ANY_CJK.findall(last)) >= 8)


#: What is known of texts before their words are: the hash of their beginning, and length and hashes of what is left without dots at the end.
BASE = "head bigint, base int, base_1 bigint, base_2 int"
ROWS = f"doc_id bigint, source string, state string, punctuated boolean, {BASE}, chars bigint, bytes bigint, key string, wider string, ends bigint, total bigint"


def _hashed(text: Column, length: Column) -> tuple[Column, Column]:
    """Two hashes of a text's first characters, 96 bits in all."""
    prefix = F.substring(text, F.lit(1), length)
    return F.xxhash64(prefix), F.hash(prefix)


def _with_base(texts: DataFrame) -> DataFrame:
    rest = F.regexp_replace("text", r"(?U)[\s.。…]+\z", "")
    known = texts.withColumn("base", F.length(rest))
    one, two = _hashed(F.col("text"), F.col("base"))
    return known.withColumns({"head": F.when(F.col("base") >= HEAD, F.xxhash64(F.substring("text", 1, HEAD))), "base_1": one, "base_2": two})


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over the whole texts: a row per document, and rows of counts (without doc_id). The last word of a text counts for nothing."""
    ends, total = Counter(), Counter()

    names = [c.split()[0] for c in ROWS.split(", ")]
    nothing = (None,) * 10

    def counts() -> pd.DataFrame:
        return pd.DataFrame([(*nothing, k, None, ends[k], n) for k, n in total.items()], columns=names, dtype=object)

    for batch in batches:
        out = []
        hashes = zip(*(batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in ("head", "base", "base_1", "base_2")))
        for doc, source, text, base in zip(batch["doc_id"].tolist(), batch["source"].tolist(), batch["text"].tolist(), hashes):
            state, key, wider, at = ending(text)
            stops = count_ends(text[:at], ends, total) if state != "empty" else 0
            lines = sum(1 for x in text.split("\n")[:-1] if len(x) > 20 and x[0] != "#")  # but headings and the line in question
            punctuated = 2 * stops >= max(2, lines) or (not stops and not lines and _sentence_like(text))
            out.append((doc, source, state, punctuated, *base, len(text), len(text.encode("utf-8", "replace")), key, wider, None, None))
        yield pd.DataFrame(out, columns=names, dtype=object)
        if len(total) > HELD:
            yield counts()
            ends, total = Counter(), Counter()
    if total:
        yield counts()


def _has_longer_copy(texts: DataFrame, ends: DataFrame) -> DataFrame:
    """``doc_id`` of unfinished texts that are strict prefixes of other texts, whatever their length. Dots at the end don't count.

    A self-join by prefix in two steps. A text meets others by the hash of as many of its first characters as the largest
    power of two within its length; those tell the lengths that they are asked for (no more than that power), and answer
    with the hash of so many of their own first characters. Only hashes and lengths meet, never pairs of texts, and equal
    answers are one. A text is shuffled only where another one that is unfinished begins with the same HEAD characters.
    """
    unfinished = ends.where(F.col("state").isin("open", "dots") & (F.col("base") > 0)).select("doc_id", "head", "base", "base_1", "base_2")
    heads = ends.where("head IS NOT NULL").groupBy("head").agg(F.count("*").alias("n"), F.max(F.col("state").isin("open", "dots")).alias("open")).where("n > 1 AND open")
    ids = stage(ends.join(heads.select("head"), "head", "left_semi").select("doc_id").distinct(), "heads")  # few as a rule: then the texts are not shuffled
    some = stage(_with_base(texts.join(ids, "doc_id", "left_semi")).select("doc_id", "text", "base"), "beginnings")

    power = lambda c: F.floor(F.log2(F.col(c))).cast("int")
    key = lambda k: F.xxhash64(F.substring("text", F.lit(1), F.pow(F.lit(2), k).cast("int")), k)
    asks = some.join(unfinished.where(F.col("base") >= HEAD).select("doc_id").distinct(), "doc_id", "left_semi")
    asked = asks.withColumn("k", power("base")).select("k", key(F.col("k")).alias("key"), "base")
    asked = asked.groupBy("k", "key").agg(F.collect_set("base").alias("lengths"))
    met = some.where(F.col("base") > HEAD).withColumn("k", F.explode(F.sequence(F.lit(HEAD.bit_length() - 1), power("base")))).select("doc_id", "base", "k", key(F.col("k")).alias("key"))
    wanted = met.join(asked, ["k", "key"]).select("doc_id", F.explode(F.filter("lengths", lambda n: n < F.col("base"))).alias("length")).distinct()
    one, two = _hashed(F.col("text"), F.col("length"))
    answers = some.select("doc_id", "text").distinct().join(wanted.groupBy("doc_id").agg(F.collect_set("length").alias("lengths")), "doc_id").select("text", F.explode("lengths").alias("length"))
    answers = answers.select(F.col("length").alias("base"), one.alias("base_1"), two.alias("base_2")).distinct()
    long = unfinished.where(F.col("base") >= HEAD).join(answers, ["base", "base_1", "base_2"], "left_semi").select("doc_id")

    lengths = sorted(r[0] for r in unfinished.where(F.col("base") < HEAD).select("base").distinct().collect())  # HEAD at most
    if not lengths:
        return long.distinct()
    begun = _with_base(texts).withColumn("length", F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda n: n < F.col("base"))))
    goes_on = F.xxhash64(F.substring("text", F.col("length") + 1, F.lit(GOES_ON)))
    begun = begun.select(F.col("length").alias("base"), one.alias("base_1"), two.alias("base_2"), goes_on.alias("on")).groupBy("base", "base_1", "base_2").agg(F.min("on").alias("a"), F.max("on").alias("z")).where("a = z")
    short = unfinished.where(F.col("base") < HEAD).join(begun, ["base", "base_1", "base_2"], "left_semi").select("doc_id")
    return long.unionByName(short).distinct()


def _longer_words(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """How often words that strictly begin with each of the ``wanted`` keys occur: ``key, longer``."""
    listed = counts.where("length(key) > 1").select("total", F.explode(F.expr(f"transform(sequence(1, least(length(key) - 1, {LISTED})), n -> substring(key, 1, n))")).alias("key"))
    short = listed.groupBy("key").agg(F.sum("total").alias("longer")).join(wanted, "key", "left_semi")
    a, b = wanted.where(F.length("key") > LISTED), counts.where(F.length("key") > LISTED + 1).select(F.col("key").alias("word"), "total")
    begin = lambda df, c: df.withColumn("_begin", F.substring(c, 1, LISTED))
    met = begin(a, "key").join(begin(b, "word"), "_begin").where(F.col("word").startswith(F.col("key")) & (F.col("word") != F.col("key")))
    return short.unionByName(met.groupBy("key").agg(F.sum("total").alias("longer")))


def judged(documents: DataFrame) -> DataFrame:
    """Every document with a text: ``doc_id, source, truncated, reason``.

    A text is truncated if it is unfinished and (``copy``) a longer copy begins with it, (``broken``) it stops in a
    character, entity, link or list number, (``word``) its last word is the strict prefix of longer words and hardly
    ever stands alone elsewhere, (``phrase``) its last word hardly ever ends a sentence or line, (``stop``) it has sentence
    marks throughout but none at the end, after a word that doesn't usually go without, or (``limit``) it has the length
    at which its source cuts others. Null texts are left out, empty ones are not truncated; nothing is said of texts
    with a null id. Repeated rows give repeated rows; extra columns are ignored.
    """
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "source", "text")
    rows = stage(_with_base(texts).mapInPandas(_scan, ROWS), "ends")
    ends = rows.where("doc_id IS NOT NULL").select("doc_id", "source", "state", "punctuated", "head", "base", "base_1", "base_2", "chars", "bytes", "key", "wider")
    counts = rows.where("doc_id IS NULL").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("total").alias("total"))
    counts = stage(counts, "words")
    usual = counts.agg(F.sum("ends") / F.sum("total")).first()[0] or 0.0  # how often any word ends a sentence or line

    # words that are no words: the last ones that longer ones begin with, and that hardly occur by themselves
    longer = _longer_words(ends.where("key IS NOT NULL").select("key").distinct(), counts)
    wide = counts.select(F.col("key").alias("wider"), F.col("ends").alias("wider_ends"), F.col("total").alias("wider_total"))
    known = ends.join(counts, "key", "left").join(longer, "key", "left").join(wide, "wider", "left")
    is_part = F.coalesce("total", F.lit(0)) * PIECE <= F.coalesce("longer", F.lit(0)) - 1
    by_wider = F.col("wider").isNotNull() & (F.coalesce("total", F.lit(0)) < 2 * AVERAGE)
    total = F.coalesce(F.when(by_wider, F.col("wider_total")).otherwise(F.col("total")), F.lit(0))
    ended = F.coalesce(F.when(by_wider, F.col("wider_ends")).otherwise(F.col("ends")), F.lit(0))
    known = known.withColumn("rate", (ended + AVERAGE * usual) / (total + AVERAGE)).withColumn("surely", ended / (total + DOUBTS)).withColumn("heard", total > 0)
    copies = _has_longer_copy(texts, ends).withColumn("has_copy", F.lit(True))
    known = known.join(copies, "doc_id", "left")

    unfinished = F.col("state").isin("open", "dots")
    unusual = F.when(F.col("state") == "dots", F.col("heard")).otherwise(F.lit(True)) & ~((F.col("surely") >= USUALLY) & (F.length("key") > 1))  # one letter may be an abbreviation
    reason = (
        F.when(F.col("state") == "cut", "broken")
        .when(~unfinished, None)
        .when(F.col("has_copy"), "copy")
        .when(is_part & F.col("wider").isNull(), "word")
        .when(F.col("heard") & (F.col("rate") < RARELY), "phrase")
        .when(F.col("punctuated") & unusual & F.col("key").isNotNull(), "stop")
    )
    first = stage(known.select("doc_id", "source", "state", F.explode(F.array(F.struct(F.lit("chars").alias("u"), F.col("chars").alias("l")), F.struct(F.lit("bytes").alias("u"), F.col("bytes").alias("l")))).alias("x"), reason.alias("reason")), "judged")
    first = first.select("doc_id", "source", "state", F.col("x.u").alias("unit"), F.col("x.l").alias("length"), "reason")

    # field limits of each source, from the lengths of the texts found so far
    spread = first.where("reason IS NOT NULL AND source IS NOT NULL").groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source", "unit").orderBy("length")
    near, around = F.sum("n").over(by.rangeBetween(-LIMIT_NEAR, LIMIT_NEAR)), F.sum("n").over(by.rangeBetween(-LIMIT_AROUND, LIMIT_AROUND))
    by_chance = F.col("around") / (2 * LIMIT_AROUND + 1)
    enough = (F.col("n") - DEVIATIONS * F.sqrt("n") >= F.greatest(F.lit(1.0), by_chance)) & (F.col("n") >= LIMIT_EACH * F.col("around")) & (F.col("near") >= LIMIT_SHARE * F.col("around"))
    units = spread.groupBy("source", "unit").agg(F.max("n").alias("top")).groupBy("source").agg(F.max_by("unit", F.struct("top", "unit")).alias("unit"))  # the one in which lengths agree best
    limits = spread.withColumn("near", near).withColumn("around", around).where(enough).join(units, ["source", "unit"], "left_semi").select("source", "unit", "length", F.lit(True).alias("at_limit"))
    final = first.join(limits, ["source", "unit", "length"], "left")
    each = final.groupBy("doc_id", "source", "state", "reason").agg(F.max("at_limit").alias("at_limit"), F.count("*").alias("n"))
    why = F.coalesce("reason", F.when(F.col("at_limit") & F.col("state").isin("open", "dots"), "limit"))
    return each.select("doc_id", "source", F.explode(F.array_repeat(why, F.floor(F.col("n") / 2).cast("int"))).alias("reason")).select("doc_id", "source", F.col("reason").isNotNull().alias("truncated"), "reason")


def truncated_share(documents: DataFrame) -> DataFrame:
    """Per source: ``source, documents, truncated, share``. Every row counts as a document, also one without text."""
    found = judged(documents).groupBy("source").agg(F.count_if("truncated").alias("truncated"))
    rows = documents.groupBy("source").agg(F.count("*").alias("documents"))
    both = rows.alias("a").join(found.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    n = F.coalesce("b.truncated", F.lit(0))
    return both.select("a.source", "a.documents", n.alias("truncated"), (n / F.col("a.documents")).alias("share"))
