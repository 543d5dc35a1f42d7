"""Layouts of line heads, mined by token trees of fixed depth, and which of their slots hold times and speakers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Tokens of a head at most (levels of the tree), tokens between two marks at most, words that a node tells apart, nodes from which on a task gives its tree away and begins another.
DEPTH, RUN, CHILDREN, NODES = 12, 5, 16, 20_000
#: Share of a slot's values that must be people for it to be a speaker slot; the same where a head begins within a line.
LEAST_SHARE, LEAST_INNER = 0.1, 0.2
#: Share of a slot's values that must read as times, and how well they must follow the cues' own (correlation), from so many on.
LEAST_TIMES, FOLLOWS, ENOUGH = 0.5, 0.5, 3
#: Share from which a word that stands in one place is a constant of the layout.
CONSTANT = 0.5
#: Layouts that are given to all workers; if there are more, each cue is joined to those of its own heads.
MOST_LAYOUTS = 50_000

#: Any word in a layout, any whole number, and the end of a label column.
WORD, NUMBER, END = "<*>", "<#>", "<$>"
# Where a head begins: a line, after a sentence or a closing mark, or two capitalized words within a line. The column of labels is a line of its own.
LINE, AFTER, INNER, COLUMN = "line", "after", "inner", "column"

# a number or time, a word, a dot or comma, a sign of speech, a mark
_TOKEN = re.compile(r"(\d+(?:[:.,]\d+)*)|([^\W\d_](?:[\w'’]|[-.](?=[^\W\d_]))*)|([.,])|([!?…。！？、，؟;\"'’“”„])|(\n|[^\w\s]|_+)")
_DIGITS = re.compile(r"\d+")
_BREAK = re.compile(r"\n\s*|[.!?…♪*)\]\"”»:：>]\s+|[。！？…♪)\]”»>：]")
_INNER = re.compile(r"(?<=\s)[^\W\d_a-z][\w'’.\-]{0,40}\s{1,4}[^\W\d_a-z][\w'’.\-]{0,40}(?=\s?[^\w\s.,!?'’…。！？、\-])")
_MARKED = re.compile(r"[^\w\s.,!?'’…。！？、\-]|\n|(?<!\S)-(?!\S)|\d:\d")

# what a head can't do without, told before its tokens are: a mark or time after RUN tokens at most
_WORD = r"[^\W\d_](?:[\w'’]|[-.](?=[^\W\d_]))*"
_MARK = r"[^\w\s.,!?…。！？、，؟;\"'’“”„]|\n|_"
_HAS_MARK = re.compile(rf"[^\S\n]*(?>(?>{_WORD}|\d+(?:[.,]\d+)*|[.,])[^\S\n]*){{0,{RUN}}}(?:{_MARK}|\d+:\d)")
#: For Spark: texts that may hold a head.
MAY_HOLD = r"[^\p{L}\p{N}\s.,!?'’…。！？、\-_]|_|\n|(?:^|\s)-(?:\s|$)|\d:\d"

#: A token of a head: its kind, its key in the tree, and where it stands.
RUN_WORD, RUN_OTHER, MARK, TIME = range(4)
Token = tuple[int, str, int, int]


def starts(text: str) -> list[tuple[int, str]]:
    """Where heads may begin, in order, each with how it begins."""
    found = {m.start(): INNER for m in _INNER.finditer(text)}
    for m in _BREAK.finditer(text):
        found[m.end()] = LINE if m[0][0] == "\n" else AFTER
    found[0] = LINE
    return sorted(found.items())


def head(text: str, at: int) -> list[Token]:
    """The tokens of the head that begins at ``at``, up to its last mark. Plain speech has none: more than RUN tokens without a mark end it, as does a sentence's end."""
    out: list[Token] = []
    last = run = 0
    for m in _TOKEN.finditer(text, at):
        kind = m.lastindex
        if kind == 5:
            out.append((MARK, m[0], *m.span()))
            last, run = len(out), 0
        elif kind == 4:
            break
        elif kind == 1 and ":" in m[0]:
            out.append((TIME, _DIGITS.sub("#", m[0]), *m.span()))
            last, run = len(out), 0
        else:
            run += 1
            if run > RUN:
                break
            out.append((RUN_WORD, m[0], *m.span()) if kind == 2 else (RUN_OTHER, NUMBER if kind == 1 else m[0], *m.span()))
        if len(out) >= DEPTH:
            break
    return out[:last]


def heads(text: str) -> Iterator[tuple[str, list[Token]]]:
    if _MARKED.search(text):
        for at, how in starts(text):
            if _HAS_MARK.match(text, at) and (tokens := head(text, at)):
                yield how, tokens


def column_head(label: str) -> list[Token]:
    """A label column is one head, closed by its end."""
    return [*((k, t, a, z) for k, t, a, z in _all(label))][: DEPTH - 1] + [(MARK, END, len(label), len(label))]


def _all(text: str) -> Iterator[Token]:
    for m in _TOKEN.finditer(text):
        kind = m.lastindex
        yield RUN_WORD if kind == 2 else RUN_OTHER if kind in (1, 3) else MARK, NUMBER if kind == 1 else m[0], m.start(), m.end()


def run_before(tokens: list[Token], k: int) -> int:
    """Where the run of words, numbers, dots and commas that the mark ``k`` closes begins; ``k`` if there is none with a word."""
    i = k
    words = False
    while i and tokens[i - 1][0] < MARK:
        i -= 1
        words |= tokens[i][0] == RUN_WORD
    return i if words else k


def seconds(code: str) -> float | None:
    """Seconds of a time with two or three parts, or None."""
    parts = code.replace(",", ".").split(":")
    try:
        values = [float(p) for p in parts]
    except ValueError:
        return None
    if not 2 <= len(values) <= 3 or any(v >= 60 for v in values[1:]):
        return None
    return sum(v * 60**k for k, v in enumerate(reversed(values)))


# n, people, times, and of times x and cue starts y the sums of x, y, xx, yy, xy
SUMS = 8


class Node:
    __slots__ = ("children", "passed", "sums")

    def __init__(self) -> None:
        self.children: dict[str, Node] = {}
        self.passed = 0
        self.sums: list[float] | None = None

    def add(self, other: Node) -> None:
        self.passed += other.passed
        if other.sums:
            self.sums = [a + b for a, b in zip(self.sums, other.sums)] if self.sums else list(other.sums)
        for key, child in other.children.items():
            self.children.setdefault(key, Node()).add(child)


class TokenTree:
    """A tree over the raw tokens of heads, of fixed depth; what a mark closes is a slot, counted at the mark's node.

    A node tells CHILDREN words apart and takes any further one as a wildcard; marks and times (by their shape) are
    always told apart. :meth:`merged` then joins the branches of words to one wildcard, so that heads that differ in
    their words only are one layout, and says which words were constant.
    """

    def __init__(self) -> None:
        self.root, self.size = Node(), 0

    def insert(self, how: str, tokens: list[Token], text: str, start_s: float, is_person: Callable[[str], bool], times: int = 1) -> None:
        """Add a head that occurs so many times."""
        at = self._child(self.root, how, False)
        for k, (kind, key, a, z) in enumerate(tokens):
            at.passed += times
            at = self._child(at, key, kind == RUN_WORD)
            if kind < MARK:
                continue
            if kind == TIME:
                x = seconds(text[a:z])
                new = [1, 0, 0, 0, 0, 0, 0, 0] if x is None else [1, 0, 1, x, start_s, x * x, start_s * start_s, x * start_s]
            else:
                i = run_before(tokens, k)
                if i == k:
                    continue
                value = text[tokens[i][2] : a]
                person = is_person(value)
                if not person and k - i > 2:
                    person = is_person(text[tokens[k - 2][2] : a])  # behind constants
                new = [times, times * person, 0, 0, 0, 0, 0, 0]
            at.sums = [p + q for p, q in zip(at.sums, new)] if at.sums else new
        at.passed += times

    @property
    def full(self) -> bool:
        """Whether the tree should be given away; it takes any head nevertheless."""
        return self.size >= NODES

    def _child(self, at: Node, key: str, word: bool) -> Node:
        child = at.children.get(key)
        if child is None:
            if word and len(at.children) >= CHILDREN:
                key = WORD
                child = at.children.get(key)
                if child is not None:
                    return child
            self.size += 1
            child = at.children[key] = Node()
        return child

    def merged(self) -> tuple[list[tuple[list[str], list[float]]], list[tuple[list[str], str, int, int]]]:
        """Layouts (path, sums), and words at wildcards (path, word, how often, of how many)."""
        rows: list[tuple[list[str], list[float]]] = []
        words: list[tuple[list[str], str, int, int]] = []

        def walk(at: Node, path: list[str]) -> None:
            if at.sums:
                rows.append((path, at.sums))
            wild = Node()
            seen: Counter = Counter()
            for key, child in at.children.items():
                if path and (key == WORD or key[0].isalpha()):
                    wild.add(child)
                    seen[key] += child.passed
                else:
                    walk(child, [*path, key])
            if seen:
                here = [*path, WORD]
                total = sum(seen.values())
                words.extend((here, w, n, total) for w, n in seen.most_common(4) if w != WORD and 4 * n >= total)
                if not any(w != WORD and 4 * n >= total for w, n in seen.items()):
                    words.append((here, "", 0, total))
                walk(wild, here)

        walk(self.root, [])
        return rows, words


MINED = "path array<string>, word string, sums array<double>"


def speaker_slot(path: Column, n: Column, people: Column) -> Column:
    least = F.when(F.element_at(path, 1) == INNER, LEAST_INNER).otherwise(LEAST_SHARE)
    return (people > 0) & (people >= least * n)


def decided(mined: DataFrame) -> DataFrame:
    """Layouts of all tasks with what their last slot is: ``path, n, people, times, follows, is_speaker, is_time, constants``.

    ``mined`` has the rows of :meth:`TokenTree.merged` (words with a ``word``). ``follows`` is the correlation of the
    slot's times with the starts of their cues; ``constants`` are the wildcards of the path that one word mostly fills,
    as ``struct<position, word>``.
    """
    s = lambda k: F.sum(F.element_at("sums", k + 1))
    names = ("n", "people", "times", "x", "y", "xx", "yy", "xy")
    per = mined.where("word IS NULL").groupBy("path").agg(*[s(k).alias(c) for k, c in enumerate(names)])
    spread = (F.col("times") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("times") * F.col("yy") - F.col("y") * F.col("y"))
    follows = F.when((F.col("times") >= ENOUGH) & (spread > 0), (F.col("times") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(spread))
    made = per.withColumn("follows", follows)
    is_time = (F.col("times") > 0) & (F.col("times") >= LEAST_TIMES * F.col("n")) & F.coalesce(F.col("follows") >= FOLLOWS, F.lit(True))
    made = made.select("path", F.col("n").cast("bigint").alias("n"), F.col("people").cast("bigint").alias("people"), F.col("times").cast("bigint").alias("times"), "follows", speaker_slot(F.col("path"), F.col("n"), F.col("people")).alias("is_speaker"), is_time.alias("is_time"))

    counted = mined.where("word IS NOT NULL").groupBy("path", "word").agg(s(0).alias("k"), s(1).alias("total"))
    share = counted.groupBy("path").agg(F.max_by("word", F.struct("k", "word")).alias("word"), F.max("k").alias("k"), F.sum(F.when(F.col("word") == "", F.col("total"))).alias("rest"), F.max("total").alias("total"))
    constant = share.where(F.col("k") >= CONSTANT * F.greatest("total", F.coalesce("rest", F.lit(0.0)))).select("path", "word")
    ups = made.select("path", F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.size("path")), lambda i: F.element_at("path", i) == WORD), lambda i: F.struct(i.alias("position"), F.slice("path", 1, i).alias("at")))).alias("u"))
    held = ups.join(constant.withColumnRenamed("path", "at"), F.col("u.at") == F.col("at")).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("u.position", "word"))).alias("constants"))
    return made.join(held, "path", "left").withColumn("constants", F.coalesce("constants", F.expr("CAST(array() AS array<struct<position:int,word:string>>)")))


def paths(how: str, tokens: list[Token]) -> Iterator[list[str]]:
    """The paths of all layouts that a head may follow."""
    path = [how]
    for kind, key, _, _ in tokens:
        path.append(WORD if kind == RUN_WORD else key)
        if kind >= MARK:
            yield path[:]


class Slots:
    """The layouts in use, or those of one cue's heads, as a tree to walk along a head.

    ``complete`` says whether it holds all that there are, as it does in all queries; else heads are judged by their values.
    """

    def __init__(self, rows: list[tuple[list[str], bool, bool, list[str]]], complete: bool = True) -> None:
        self.root: dict = {}
        self.complete = complete
        for path, speaker, time, constants in rows:
            at = self.root
            for key in path:
                at = at.setdefault(key, {})
            at[None] = (speaker, time, frozenset(constants))

    def walk(self, how: str, tokens: list[Token]) -> Iterator[tuple[int, bool, bool, frozenset]]:
        """The marks and times that close a known slot: (number of the token, speaker, time, constants)."""
        at = self.root.get(how)
        for k, (kind, key, _, _) in enumerate(tokens):
            if at is not None:
                at = at.get(WORD if kind == RUN_WORD else key)
            if at is None:
                if self.complete:
                    return
                if kind >= MARK:
                    yield k, kind == MARK, kind == TIME, frozenset()
            elif kind >= MARK and None in at:
                yield k, *at[None]
