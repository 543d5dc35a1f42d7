"""Speaker turns out of transcripts whose cues name their speakers in many layouts."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cuewright.llm.layouts import COLUMN, MAY_HOLD, MINED, MOST_LAYOUTS, RUN_WORD, Slots, Token, TokenTree, column_head, decided, heads, paths, run_before
from cuewright.operators.ordered import cell, join_one, neighbour
from cuewright.sources.tables import counted_cues
from cuewright.staging import stage

#: People that the name index may hold on each worker; a directory beyond it is refused rather than cut.
MOST_PEOPLE = 200_000

# Hesitation sounds, as patterns because they are drawn out at will; those that are words in a language; and words around a name that are no part of it.
SOUNDS = "u+h*m+|u+h+|e+r+m*|h+m+|m+h*m+|ä+h*m*|ö+h*m*|e+u+h+|h+e+u+|h+u+m+|e+h+m*|e+m+|a+h+|으*음+|어+|흠+|에+|えー*っ?と[ー〜]*|あの[ー〜]+|う[ー〜]*ん"
WORDS_IN = {"de": "er|um"}
HESITATION = re.compile(f"(?:{SOUNDS})", re.I)
#: Sounds that are a word in no language, for where the language isn't known yet.
PLAIN_HESITATION = re.compile(f"(?!(?:{'|'.join(WORDS_IN.values())})\\Z)(?:{SOUNDS})", re.I)
BESIDE_NAMES = {"dr", "mr", "mrs", "ms", "prof", "host", "guest", "moderator", "narrator", "herr", "frau", "sr", "sra", "mme", "st"}

_SOUND = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|\*[^*]*\*|♪[^♪]*♪|♪|<[^<>]*>")
_PLAIN = re.compile(r"[^\W_]+(?:['’ー〜-]+[^\W_]*)*")
_SPACES = re.compile(r"[^\S\n]{2,}|\s*\n\s*")
_NUMBERED = re.compile(r"\s*speaker[ _]*(\d{1,9})\s*", re.I)
_OPENERS = re.compile(r"(?:[\[(<{|]|>>|(?:(?<=\s)|^)[-–—])\s*\Z")


def _fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def distance(a: str, b: str, most: int) -> int:
    """Edits (with swaps of neighbours) between two words, or ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


BAG = 32


def _bag(word: str) -> np.ndarray:
    """Numbers of letters, some of which share a place."""
    return np.bincount([ord(c) % BAG for c in word], minlength=BAG).astype(np.int16)


class People:
    """Finds the person a label names: by number, full name in either order, one part of it, or slightly misspelled."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]]) -> None:
        self.ids = {r[0] for r in rows}
        self.exact: dict[str, set[int]] = {}
        for pid, *parts in rows:
            for part in parts:
                for word in _fold(part or "").split():
                    self.exact.setdefault(word, set()).add(pid)
        self.words = list(self.exact)
        self.bags = np.array([_bag(w) for w in self.words], np.int16).reshape(-1, BAG)
        self.known: dict[str, int | None] = {}
        self.near: dict[str, set[int]] = {}

    def word(self, w: str) -> set[int]:
        """People with a part like the word. What was looked up is kept, up to a bound."""
        if w in self.exact:
            return self.exact[w]
        if w not in self.near:
            if len(self.near) > 200_000:
                self.near.clear()
            self.near[w] = self._word(w)
        return self.near[w]

    def _word(self, w: str) -> set[int]:
        most = 2 if len(w) >= 6 else 1 if len(w) >= 4 else 0
        if not most:
            return set()
        # each edit changes the numbers of letters by two at most, so few words are left to compare
        near = np.nonzero(np.abs(self.bags - _bag(w)).sum(axis=1) <= 2 * most)[0]
        best = {self.words[k]: distance(w, self.words[k], most) for k in near}
        least = min(best.values(), default=9)
        return set().union(*(self.exact[x] for x, d in best.items() if d == least)) if least <= most else set()

    def find(self, label: str) -> int | None:
        """The person, or None where nobody or more than one fits."""
        if label not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[label] = self._find(label)
        return self.known[label]

    def _find(self, label: str) -> int | None:
        if n := _NUMBERED.fullmatch(label.replace("\xa0", " ")):
            return int(n[1]) if int(n[1]) in self.ids else None
        words = [w for w in re.findall(r"[^\W_]+", _fold(label)) if w not in BESIDE_NAMES]
        if not 0 < len(words) <= 4:
            return None
        fits: set[int] | None = None
        for w in words:
            if len(w) == 1:
                continue
            got = self.word(w)
            if not got:
                return None
            fits = got if fits is None else fits & got
        return next(iter(fits)) if fits and len(fits) == 1 else None


def has_words(text: str) -> bool:
    """Whether words are left once hesitation sounds, sound descriptions and markup are removed."""
    rest = _SOUND.sub(" ", text) if "[" in text or "(" in text or "*" in text or "♪" in text or "<" in text else text
    for m in _PLAIN.finditer(rest):
        if not HESITATION.fullmatch(m[0].strip("-ー〜") or m[0]) and not HESITATION.fullmatch(m[0]):
            return True
    return False


def _even(text: str | None) -> str:
    """The text with blanks that are the same everywhere: a line break is one, other white space is one blank."""
    if not text or text == (plain := " ".join(text.split())):
        return text or ""
    return _SPACES.sub(lambda m: "\n" if "\n" in m[0] else " ", text.replace("\xa0", " ")).lstrip() if "\n" in text else plain


def _label(text: str, tokens: list[Token], i: int, k: int, constants: frozenset, find: Callable[[str], int | None]) -> int | None:
    """The person that the run of tokens ``i`` to ``k`` names, as it stands or without the layout's constant words."""
    person = find(text[tokens[i][2] : tokens[k][2]])
    if person is None and constants:
        person = find(" ".join(text[a:z] for _, key, a, z in tokens[i:k] if key not in constants))
    return person


def named_by_column(speaker: str | None, find: Callable[[str], int | None], slots: Slots) -> int | None:
    """The person that a label column names, by the slots of its layout."""
    if speaker and speaker.strip():
        tokens = column_head(speaker)
        for k, is_speaker, _, constants in slots.walk(COLUMN, tokens):
            i = run_before(tokens, k)
            if is_speaker and i < k and (person := _label(speaker, tokens, i, k, constants, find)) is not None:
                return person
    return None


Part = tuple[int | None, bool, str]


def parts_of(text: str | None, person: int | None, find: Callable[[str], int | None], slots: Slots) -> list[Part]:
    """A cue as parts (person or None, whether it has words, text), cut where a speaker slot of a layout names a person.

    ``person`` is who the cue's label column names. Times in time slots are taken out; a label in a speaker slot that
    names nobody stays in the text but is no word.
    """
    text = _even(text)
    out: list[Part] = []
    skips: list[tuple[int, int, bool]] = []  # stretches that are no words, and whether they stay in the text
    at = 0
    for how, tokens in heads(text):
        if tokens[-1][3] <= at:
            continue
        for k, is_speaker, is_time, constants in slots.walk(how, tokens):
            _, _, a, z = tokens[k]
            if a < at:
                continue
            if is_time:
                skips.append((a, z, False))
            elif is_speaker and (i := run_before(tokens, k)) < k and tokens[i][2] >= at:
                who = _label(text, tokens, i, k, constants, find)
                if who is not None:
                    out.append(_part(person, text, at, tokens[i][2], skips))
                    person, skips, at = who, [], z
                    break
                if not any(t[1] in ".," for t in tokens[i:k]):  # else what follows the dot is looked at by itself
                    skips.append((tokens[i][2], z, True))
    out.append(_part(person, text, at, len(text), skips))
    return out


def _part(person: int | None, text: str, start: int, end: int, skips: list[tuple[int, int, bool]]) -> Part:
    counted, kept, at = [], [], start
    for a, z, stays in sorted(skips):
        if at <= a and z <= end:
            counted.append(text[at:a])
            kept += [text[at:a], text[a:z] if stays else " "]
            at = z
    counted.append(text[at:end])
    kept.append(text[at:end])
    return person, has_words(" ".join(counted)), "".join(kept)


PARTS = "array<struct<person:int,words:boolean,text:string>>"


def _cues(segments: DataFrame, all_: bool = False) -> DataFrame:
    """Cues with an id and a time; only those with a label or with marks in their text unless ``all_`` are wanted."""
    rows = segments.where("source_id IS NOT NULL AND seg_idx IS NOT NULL AND start_ms IS NOT NULL")
    if not all_:
        rows = rows.where(F.coalesce(F.trim("speaker") != "", F.lit(False)) | F.coalesce(F.col("text").rlike(MAY_HOLD), F.lit(False)))
    return rows.select("source_id", F.col("seg_idx").cast("int"), F.col("start_ms").cast("bigint"), "text", "speaker")


def _directory(speakers: DataFrame) -> list[tuple[int, str | None, str | None]]:
    rows = speakers.where("speaker_id IS NOT NULL").select("speaker_id", "given_name", "family_name").distinct().limit(MOST_PEOPLE + 1).collect()
    if len(rows) > MOST_PEOPLE:
        raise ValueError(f"more than {MOST_PEOPLE} people")
    return [tuple(r) for r in rows]


def _rows(tree: TokenTree) -> pd.DataFrame:
    rows, words = tree.merged()
    return pd.DataFrame([(path, None, sums) for path, sums in rows] + [(path, word, [float(n), float(total)]) for path, word, n, total in words], columns=["path", "word", "sums"])


def layouts(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """The layouts of the cues' line heads: ``path, n, people, times, follows, is_speaker, is_time, constants``.

    Each task mines token trees of fixed depth over the heads of its cues (:mod:`cuewright.llm.layouts`), beginning
    another when one is full; equal layouts of all trees are then added up.
    """
    people = _directory(speakers)

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, tree = People(people), TokenTree()
        known = lambda label: who.find(label) is not None
        for b in batches:
            for speaker, n in b["speaker"].value_counts(sort=False).items():
                if speaker.strip():
                    tree.insert(COLUMN, column_head(speaker), speaker, 0.0, known, n)
                    if tree.full:
                        yield _rows(tree)
                        tree = TokenTree()
            for text, start in zip(b["text"].tolist(), b["start_ms"].tolist()):
                if text:
                    text = _even(text)
                    for how, tokens in heads(text):
                        tree.insert(how, tokens, text, start / 1000, known)
                    if tree.full:
                        yield _rows(tree)
                        tree = TokenTree()
        yield _rows(tree)

    return decided(stage(_cues(segments).mapInPandas(mine, MINED), "mined"))


def _with_layouts(cues: DataFrame, used: DataFrame) -> DataFrame:
    """Cues with ``layouts``: as JSON, the layouts among ``used`` that their own heads follow, however many there are in all."""

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for text, speaker in zip(b["text"].tolist(), b["speaker"].tolist()):
                met = {tuple(x) for how, tokens in heads(_even(text)) for x in paths(how, tokens)}
                if speaker and speaker.strip():
                    met |= {tuple(x) for x in paths(COLUMN, column_head(speaker))}
                found.append([list(x) for x in sorted(met)])
            yield b.assign(paths=pd.Series(found, index=b.index, dtype=object))

    kinds = ", ".join(f"{n} {k}" for n, k in cues.dtypes)
    told = stage(cues.mapInPandas(follow, f"{kinds}, paths array<array<string>>"), "paths")
    each = told.select("paths").distinct().select("paths", F.explode("paths").alias("path")).join(used, "path")
    by = each.groupBy("paths").agg(F.to_json(F.collect_list(F.struct("path", "is_speaker", "is_time", "constants"))).alias("layouts"))
    return join_one(told, by, "paths", "seg_idx").drop("paths")


def cue_parts(segments: DataFrame, speakers: DataFrame, with_text: bool = False) -> DataFrame:
    """``source_id, seg_idx, start_ms, parts`` of each cue that names a person (``with_text``: of all cues).

    The layouts are mined first; parts are then cut by the slots of the layouts, which all workers get, or, if there are
    more than MOST_LAYOUTS, by those that a join finds for the cue. Rows without source, index or start are left out.
    """
    people = _directory(speakers)
    used = stage(layouts(segments, speakers).where("is_speaker OR is_time"), "layouts")
    used = used.select("path", "is_speaker", "is_time", F.transform("constants", lambda c: c["word"]).alias("constants"))
    rows = used.limit(MOST_LAYOUTS + 1).collect()
    many = len(rows) > MOST_LAYOUTS
    slots = None if many else Slots([tuple(r) for r in rows])

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = People(people).find
        for b in batches:
            keep, parts = [], []
            own = b["layouts"].tolist() if many else [None] * len(b)
            trees = {x: Slots([(r["path"], r["is_speaker"], r["is_time"], r["constants"]) for r in json.loads(x)] if x else []) for x in set(own)} if many else {None: slots}
            labels: dict[tuple, int | None] = {}
            for i, (text, speaker, at) in enumerate(zip(b["text"].tolist(), b["speaker"].tolist(), own)):
                if (speaker, at) not in labels:
                    labels[speaker, at] = named_by_column(speaker, find, trees[at])
                found = parts_of(text, labels[speaker, at], find, trees[at])
                if with_text or len(found) > 1 or found[0][0] is not None:
                    keep.append(i)
                    parts.append([{"person": p[0], "words": p[1], "text": _OPENERS.sub("", p[2].strip()) if with_text else None} for p in found])
            some = b[["source_id", "seg_idx", "start_ms"]].iloc[keep]
            yield some.assign(parts=pd.Series(parts, index=some.index, dtype=object))

    cues = _cues(segments, with_text)
    return (_with_layouts(cues, used) if many else cues).mapInPandas(extract, f"source_id string, seg_idx int, start_ms bigint, parts {PARTS}")


def spoken_parts(segments: DataFrame, speakers: DataFrame, transcripts: DataFrame, with_text: bool = False) -> DataFrame:
    """Parts with words, of cues of known sources, each cue once: ``source_id, start_ms, seg_idx, part, person, text``."""
    parts = stage(cue_parts(segments, speakers, with_text), "parts")
    once = counted_cues(parts, transcripts, keep=("start_ms", "parts"))
    each = once.select("source_id", "seg_idx", "start_ms", F.posexplode("parts").alias("part", "p"))
    return each.where("p.words").select("source_id", "start_ms", "seg_idx", "part", "p.person", "p.text")


def turn_starts(parts: DataFrame) -> DataFrame:
    """The parts that begin a turn: those that name a person other than the one named before (or the first named)."""
    named = parts.where("person IS NOT NULL").withColumn("_cell", cell(F.col("start_ms")))
    before = neighbour(named, ["source_id"], ["start_ms", "seg_idx", "part"], ["person"], "_before_")
    return before.where("_before_person IS NULL OR _before_person <> person").drop("_before_person")


def speaker_turns(segments: DataFrame, speakers: DataFrame, transcripts: DataFrame) -> DataFrame:
    """One row per turn: ``source_id, first_seg_idx, speaker_id, start_ms``, a turn being a longest run of speech by one person.

    Cues count once per (``source_id``, ``seg_idx``) and are taken in order of ``start_ms``. A cue that names nobody
    known goes to whoever spoke last; parts without words count for nothing, whomever they name. Null or empty texts
    have no words; sources outside ``transcripts`` and cues before the first name give no turn; extra columns are ignored.
    """
    starts = turn_starts(spoken_parts(segments, speakers, transcripts))
    return starts.select("source_id", F.col("seg_idx").alias("first_seg_idx"), F.col("person").alias("speaker_id"), "start_ms")


def clean_words(text: Column, language: Column) -> Column:
    """The text without sound descriptions, markup, doubled spaces and hesitation sounds, but for sounds that are words in its language."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[^\[\]]*\]|\([^()]*\)|\*[^*]*\*|♪[^♪]*♪|♪|<[^<>]*>|>>|-->", " ")
    sounds = lambda but: rf"(?iU)(?<![\w])(?:[-–] )?{but}(?:{SOUNDS})(?![\w])(?:\.\.\.|,|、| [-–])?"
    heard = F.regexp_replace(plain, sounds(""), " ")
    for lang, words in WORDS_IN.items():
        heard = F.when(language == lang, F.regexp_replace(plain, sounds(f"(?!(?:{words})(?![\\w]))"), " ")).otherwise(heard)
    return F.trim(F.regexp_replace(F.regexp_replace(heard, r"(?U)\s[-–—]+\s*\z", ""), r"(?U)\s+", " "))


def _once(lines: str) -> Column:
    """The words of each line, without lines that repeat the one before."""
    words = F.filter(F.transform(lines, lambda x: x["w"]), lambda w: w != "")
    return F.filter(words, lambda w, i: (i == 0) | (w != F.element_at(words, F.greatest(F.lit(1), i))))


def turn_texts(segments: DataFrame, speakers: DataFrame, transcripts: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """Turns with clean words: ``source_id, turn_seg_idx, speaker_id, start_ms, part, cues, text``.

    ``languages`` gives the language of cues (``source_id, seg_idx, language``), by which a sound is told from a word
    that is spelled alike; cues it doesn't have are cleaned as if in no language with such words.
    Each part of a cue finds its turn by the last start before it, over time cells; the words of a turn are then joined
    in order. A turn that runs over full hours comes in as many rows, numbered by ``part``, so that a recording of one
    voice is no single row.
    """
    parts = stage(spoken_parts(segments, speakers, transcripts, with_text=True), "spoken")
    said = languages if languages is not None else parts.where("false").select("source_id", "seg_idx", F.lit(None).cast("string").alias("language"))
    begins = turn_starts(parts).select("source_id", "start_ms", "seg_idx", "part", F.struct(F.col("seg_idx").alias("i"), F.col("part").alias("k"), F.col("start_ms").alias("t"), F.col("person").alias("p")).alias("turn"))
    marked = parts.join(begins, ["source_id", "start_ms", "seg_idx", "part"], "left").withColumn("_cell", cell(F.col("start_ms")))
    near = Window.partitionBy("source_id", "_cell").orderBy("start_ms", "seg_idx", "part")
    along = Window.partitionBy("source_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("source_id", "_cell").agg(F.max_by("turn", F.when(F.col("turn").isNotNull(), F.struct("start_ms", "seg_idx", "part"))).alias("_in"))
    carried = carried.withColumn("_in", F.last("_in", ignorenulls=True).over(along))
    inside = marked.withColumn("turn", F.last("turn", ignorenulls=True).over(near)).join(carried, ["source_id", "_cell"])
    owned = inside.withColumn("turn", F.coalesce("turn", "_in")).where("turn IS NOT NULL").join(said, ["source_id", "seg_idx"], "left")
    lines = owned.groupBy("source_id", "turn", "_cell").agg(F.count_distinct("seg_idx").alias("cues"), F.sort_array(F.collect_list(F.struct("start_ms", "seg_idx", "part", clean_words(F.col("text"), F.col("language")).alias("w")))).alias("l"))
    return lines.select("source_id", F.col("turn.i").alias("turn_seg_idx"), F.col("turn.p").alias("speaker_id"), F.col("turn.t").alias("start_ms"), (F.col("_cell") - cell(F.col("turn.t"))).cast("int").alias("part"), "cues", F.array_join(_once("l"), " ").alias("text"))
