"""Which documents hold passages of evaluation items, by a positional inverted index."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cuewright.staging import stage

#: Words that a hit consists of, one after the other (fewer in an item that is shorter).
WIDTH = 3
#: Words that a passage has at least (fewer in an item that is shorter), and the share of an item's words that counts as a leak.
PASSAGE_WORDS = 9
LEAST_SHARE = 1 / 3
#: Within a passage: most words from one hit to the next, and most that one side may have more than the other there.
STEP, SHIFT = 6, 3
#: Words of all items that one pass over the index looks for; more items are searched in blocks.
BLOCK_WORDS = 2_000_000
#: Words of the documents of one shard of the index, and words whose hash a task keeps.
SHARD, KEPT = 1_000_000, 1_000_000

_CJK = "぀-ヿ㐀-䶿一-鿿々"
_WORD = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_UNSEEN = re.compile("[­​-‏⁠﻿]")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\n\s*(?=[^\W\d_])")


def words(text: str) -> list[str]:
    """The words as they compare: without markup, entities, invisible characters, line breaks in words, case and accents."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "-" in text:
        text = _BROKEN.sub("", text)
    if text.isascii():
        return _WORD.findall(text.lower())
    text = unicodedata.normalize("NFKD", _UNSEEN.sub("", text).casefold())
    plain = "".join(c for c in text if not unicodedata.combining(c) or "゙" <= c <= "゚")
    return _WORD.findall(unicodedata.normalize("NFC", plain))


class Hashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
        return h

    def of(self, text: str) -> np.ndarray:
        return np.array([self[x] for x in words(text)], np.int64)


#: One shard: its terms (hashes of words, sorted), where the postings of each end, the postings (places of the term in the
#: shard's words, ascending), where each document's words begin, and the documents.
SHARDS = "terms array<bigint>, ends array<int>, places array<int>, starts array<int>, doc_ids array<bigint>"


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = Hashes()
    ids: list[int] = []
    found: list[np.ndarray] = []
    size = 0

    def shard() -> pd.DataFrame:
        word = np.concatenate(found)
        places = np.argsort(word, kind="stable").astype(np.int32)
        word = word[places]
        first = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
        starts = np.cumsum([0, *map(len, found)]).astype(np.int32)
        cells = [word[first], np.append(first[1:], len(word)).astype(np.int32), places, starts, np.array(ids, np.int64)]
        return pd.DataFrame([cells], columns=[x.split()[0] for x in SHARDS.split(", ")])

    for batch in batches:
        for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
            w = hashes.of(text)
            if len(w):
                ids.append(doc)
                found.append(w)
                size += len(w)
            if size >= SHARD:
                yield shard()
                ids, found, size = [], [], 0
    if found:
        yield shard()


def index(documents: DataFrame) -> DataFrame:
    """The positional inverted index of all words of all documents, a row a shard. Written once, it answers any items.

    It is split by document, so postings never leave their shard, and a word that every document holds weighs on no
    single task. Rows with a null id or text have no words.
    """
    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text").mapInPandas(_index, SHARDS)


class Items:
    """A block of items: the different hits that are looked for, and where items have them (hit, item, position), by hit.

    A hit is its words' numbers in one number, with those of each width apart; the numbers of words are under 2^21, so
    three fit 63 bits.
    """

    def __init__(self, rows: list[tuple[int, list[str]]]) -> None:
        hashes = Hashes()
        self.ids = [item for item, _ in rows]
        self.lengths = np.array([len(w) for _, w in rows], np.int64)
        self.widths = np.minimum(WIDTH, self.lengths)
        texts = [np.array([hashes[x] for x in w], np.int64) for _, w in rows]
        self.vocabulary, flat = np.unique(np.concatenate(texts), return_inverse=True)
        edges = np.cumsum([0, *self.lengths])
        self.of_width: dict[int, tuple[np.ndarray, int]] = {}  # width: sorted hits, number of the first
        hit, item, position = [], [], []
        first = 0
        for width in np.unique(self.widths).tolist():
            mine = np.nonzero(self.widths == width)[0]
            codes = [self.codes(flat[edges[k] : edges[k + 1]], width) for k in mine]
            known, number = np.unique(np.concatenate(codes), return_inverse=True)
            self.of_width[width] = known, first
            hit.append(number + first)
            item.append(np.repeat(mine, [len(c) for c in codes]))
            position.append(np.concatenate([np.arange(len(c)) for c in codes]))
            first += len(known)
        self.hits = first
        hit = np.concatenate(hit)
        order = np.argsort(hit, kind="stable")
        self.item, self.position = np.concatenate(item)[order], np.concatenate(position)[order]
        self.bounds = np.searchsorted(hit[order], np.arange(first + 1))
        self.hit = hit[order]
        self.skip = np.maximum(0, np.ceil(self.lengths * LEAST_SHARE / 3).astype(np.int64) - 1)
        self.need = np.maximum(1, np.ceil(self.lengths * LEAST_SHARE / 2).astype(np.int64) - self.skip)

    def codes(self, w: np.ndarray, width: int) -> np.ndarray:
        """Of words in order the hits that begin at each."""
        n = len(w) - width + 1
        code = w[:n].astype(np.int64)
        for j in range(1, width):
            code = code * len(self.vocabulary) + w[j : n + j]
        return code

    def seeds(self, counts: np.ndarray) -> np.ndarray:
        """Which places of items have hits rare enough to be looked for first, of counts by hit.

        A leak has half as many hits as it covers words. Leaving out the commonest hits of an item, fewer than that, so
        loses no leak, whatever the counts; what is left out is what everyday phrases share. At least ``need`` others remain.
        """
        order = np.lexsort((self.position, -counts[self.hit], self.item))
        item = self.item[order]
        rank = np.arange(len(order)) - np.searchsorted(item, item)
        keep = np.empty(len(order), bool)
        keep[order] = rank >= self.skip[item]
        return keep


def _pairs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [first, last): the row of each element, and the element."""
    n = last - first
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]


def _hits(items: Items, s) -> tuple[np.ndarray, np.ndarray]:
    """Hits of the items in a shard, as (number of the hit, place of its first word).

    Only the lists of the items' words are read. They are laid side by side in order of place; where a list moved by one
    and one moved by two hold the same place, three words stand in a row.
    """
    terms, ends, starts = np.asarray(s.terms), np.asarray(s.ends, np.int64), np.asarray(s.starts, np.int64)
    at = np.minimum(np.searchsorted(terms, items.vocabulary), len(terms) - 1)
    here = np.nonzero(terms[at] == items.vocabulary)[0]
    word, k = _pairs(np.concatenate([[0], ends[:-1]])[at[here]], ends[at[here]])
    word_at = np.full(int(starts[-1]) + WIDTH, -1, np.int32)
    word_at[np.asarray(s.places)[k]] = here[word]
    place = np.nonzero(word_at >= 0)[0]
    last = starts[np.searchsorted(starts, place, side="right")]  # where the document ends
    found = []
    for width, (known, first) in items.of_width.items():
        mine = place[place + width <= last]
        code = word_at[mine].astype(np.int64)
        for j in range(1, width):
            beside = word_at[mine + j]
            ok = beside >= 0
            mine, code = mine[ok], code[ok] * len(items.vocabulary) + beside[ok]
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        ok = known[at] == code
        found.append((at[ok] + first, mine[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def passages(hits: list[tuple[int, int]], least: int, width: int = WIDTH) -> tuple[set[int], list[tuple[int, int, bool]]]:
    """Words of the item that passages cover, and the passages, of hits (position in the document, in the item), sorted.

    A hit goes to the passage that it continues with the smallest shift. A passage counts if it covers ``least`` words
    and has a hit for every two of them; it is given as its first and last word in the document, and whether it is an
    exact phrase: no word between them is changed, added or missing.
    """
    open_: list[list[tuple[int, int]]] = []
    done: list[list[tuple[int, int]]] = []
    for d, i in hits:
        best, by = None, SHIFT + 1
        for p in open_:
            ld, li = p[-1]
            shift = abs((d - ld) - (i - li))
            if 0 < d - ld <= STEP and 0 < i - li <= STEP and shift < by:
                best, by = p, shift
        if best is None:
            done += [p for p in open_ if d - p[-1][0] > STEP]
            open_ = [p for p in open_ if d - p[-1][0] <= STEP]
            open_.append([(d, i)])
        else:
            best.append((d, i))
    covered: set[int] = set()
    found = []
    for p in done + open_:
        w = {i + k for _, i in p for k in range(width)}
        if len(w) >= least and 2 * len(p) >= len(w):
            covered |= w
            exact = all(b[0] - a[0] == b[1] - a[1] <= width for a, b in zip(p, p[1:]))
            found.append((p[0][0], p[-1][0] + width - 1, exact))
    return covered, sorted(found)


MATCHES = "item_id bigint, doc_id bigint, share double, kind string, passages array<struct<first_word:int,last_word:int,exact:boolean>>"


def _search(items: Items, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, width = len(items.ids), int(items.lengths.max()) + 1
    for batch in batches:
        out = []
        for s in batch.itertuples(index=False):
            hit, place = _hits(items, s)
            if not len(hit):
                continue
            starts = np.asarray(s.starts, np.int64)
            k, e = _pairs(items.bounds[hit], items.bounds[hit + 1])
            doc = (np.searchsorted(starts, place, side="right") - 1)[k]
            key = doc * n + items.item[e]
            # from the rarest terms: pairs (document, item) with enough hits
            rare = items.seeds(np.bincount(hit, minlength=items.hits))[e]
            distinct = np.unique(key[rare] * width + items.position[e[rare]])
            pair, count = np.unique(distinct // width, return_counts=True)
            pair = pair[count >= items.need[pair % n]]
            if not len(pair):
                continue
            # all hits of these items in these documents
            which = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
            mine = np.nonzero(pair[which] == key)[0]
            which, d, i = which[mine], (place[k] - starts[doc])[mine], items.position[e[mine]]
            order = np.lexsort((i, d, which))
            which, d, i = which[order], d[order].tolist(), i[order].tolist()
            edges = np.searchsorted(which, np.arange(len(pair) + 1)).tolist()
            for p, a, b in zip(pair.tolist(), edges, edges[1:]):
                item, length = p % n, int(items.lengths[p % n])
                covered, parts = passages(list(zip(d[a:b], i[a:b])), min(PASSAGE_WORDS, length), int(items.widths[item]))
                if len(covered) >= LEAST_SHARE * length:
                    exact = all(x for *_, x in parts)
                    out.append((items.ids[item], int(s.doc_ids[p // n]), len(covered) / length, "exact" if exact else "proximity", [dict(zip(("first_word", "last_word", "exact"), x)) for x in parts]))
        if out:
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "share", "kind", "passages"])


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for item, text in items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        w = words(text)
        if not w:
            continue
        if block and size + len(w) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item, w))
        size += len(w)
    if block:
        yield block


def search(shards: DataFrame, items: DataFrame) -> DataFrame:
    """What an :func:`index` holds of the items: ``item_id, doc_id, share, kind, passages``, one row per pair.

    ``share`` of the item's words that passages cover, ``kind`` ``exact`` if all of them are exact phrases and
    ``proximity`` else, and each passage's first and last word in the document. Items without words match nothing, those
    of fewer than three words match where they stand as a whole. Of repeated rows with one id the best counts.
    """
    spark = shards.sparkSession
    result = None
    for block in _blocks(items):
        known = spark.sparkContext.broadcast(Items(block))  # BLOCK_WORDS words at most
        found = shards.mapInPandas(lambda b, known=known: _search(known.value, b), MATCHES)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return spark.createDataFrame([], MATCHES)
    best = result.groupBy("item_id", "doc_id").agg(F.max(F.struct("share", "kind", "passages")).alias("m"))
    return best.select("item_id", "doc_id", "m.share", "m.kind", "m.passages")


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold at least a third of an item's words in passages of its wording and order, as :func:`search` gives them.

    Case, accents, punctuation, markup, entities, line breaks and invisible characters make no difference, a few changed,
    added or missing words end no passage. Rows with a null id or text match nothing; extra columns are ignored.
    """
    return search(stage(index(documents), "index"), items)
