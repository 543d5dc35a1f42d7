"""Filling containers of fixed capacity with whole items."""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, functions as F

from cuewright.staging import stage

#: Where the tokenizer's ranks lie, and the pattern its text is split by.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Containers that a task keeps open, and items that it packs; tasks whose open containers are merged by one, and kinds that one task fills.
OPEN, ITEMS, FAN, KINDS = 64, 50_000, 16, 8


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, tokens`` of every row with an id and a text, over the whole text.

    The file of ranks is given to the executors; they need the library ``tiktoken``.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [len(encoding.encode_ordinary(t)) for t in b["text"].tolist()]})

    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInPandas(count, "doc_id bigint, tokens bigint")


class Packer:
    """Bounded-space best fit: at most ``open_`` containers are open; where an item fits none, the fullest is closed for a new one."""

    def __init__(self, capacity: int, open_: int = OPEN) -> None:
        self.capacity, self.most = capacity, open_
        self.rooms: list[tuple[int, int]] = []  # (room left, container), ascending
        self.count = 0

    def place(self, size: int) -> int:
        """The container for an item of at most the capacity. One that is full is closed at once."""
        k = bisect_left(self.rooms, (size, -1))
        if k < len(self.rooms):
            room, at = self.rooms.pop(k)
        else:
            if len(self.rooms) >= self.most:
                self.rooms.pop(0)
            room, at = self.capacity, self.count
            self.count += 1
        if room > size:
            insort(self.rooms, (room - size, at))
        return at

    @property
    def left_open(self) -> set[int]:
        return {at for _, at in self.rooms}


PLACED = "container_name string, capacity bigint, part bigint, container bigint, doc_id bigint, piece int, first_token bigint, tokens bigint, open boolean"


def _pack(items: pd.DataFrame, kinds: pd.DataFrame) -> pd.DataFrame:
    out = []
    rows = sorted(zip(items["doc_id"].tolist(), items["tokens"].tolist()))
    for name, capacity, part in kinds[["container_name", "capacity", "part"]].sort_values("container_name").itertuples(index=False) if rows else ():
        packer = Packer(capacity)
        made = []
        for doc, tokens in rows:
            for piece, first in enumerate(range(0, tokens, capacity)):  # more than one only where it exceeds the capacity
                size = min(capacity, tokens - first)
                made.append((packer.place(size), doc, piece, first, size))
        at = packer.left_open
        out += [(name, capacity, part, c, d, p, f, s, c in at) for c, d, p, f, s in made]
    return pd.DataFrame(out, columns=[x.split()[0] for x in PLACED.split(", ")])


LEFT = "container_name string, capacity bigint, part bigint, container bigint, tokens bigint, to_part bigint, to bigint, open boolean"


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Put the contents of containers left open together, from the fullest on; again a fixed number stays open."""
    group = group.sort_values(["tokens", "part", "container"], ascending=[False, True, True])
    packer = Packer(int(group["capacity"].iloc[0]))
    to = [packer.place(t) for t in group["tokens"].tolist()]
    return group.assign(to_part=group["next"], to=to, open=[t in packer.left_open for t in to])[[x.split()[0] for x in LEFT.split(", ")]]


def _rounds(left: DataFrame, parts: int) -> list[DataFrame]:
    """Merge what FAN tasks left open, then what FAN of those merges did, and so on: each task reads FAN times OPEN containers at most, however many items there are."""
    out = []
    while parts > 1:
        merged = stage(left.withColumn("next", F.floor(F.col("part") / FAN).cast("bigint")).groupBy("container_name", "next").applyInPandas(_merge, LEFT), "merged")
        out.append(merged)
        left = merged.where("open").groupBy("container_name", "capacity", F.col("to_part").alias("part"), F.col("to").alias("container")).agg(F.sum("tokens").alias("tokens"))
        parts = -(-parts // FAN)
    return out


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """Items (``doc_id, tokens``) in containers of every kind (``container_name, capacity_tokens``).

    Returns ``container_name, container_id, doc_id, piece, first_token, tokens``, the pieces of each item in containers
    that hold at most the capacity. Only items above the capacity have more than one piece: full ones and a rest.
    Items without tokens need no room and are left out, as are kinds without a positive capacity; of kinds with one
    name the largest counts. Repeated items are packed as often as they come. Empty tables give no rows.

    Each task packs some thousand items with a fixed number of containers open. What stays open is merged in a tree of
    tasks, each of which again keeps a fixed number open.
    """
    kinds = containers.where("container_name IS NOT NULL AND capacity_tokens > 0").groupBy("container_name").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    items = sizes.where("doc_id IS NOT NULL AND tokens > 0")
    parts = max(1, -(-items.count() // ITEMS))
    blocks = max(1, -(-kinds.count() // KINDS))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    mine = items.select("doc_id", F.col("tokens").cast("bigint").alias("tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"), every(blocks).alias("block"))
    theirs = kinds.withColumn("block", F.pmod(F.xxhash64("container_name"), F.lit(blocks))).withColumn("part", every(parts))
    placed = stage(mine.groupBy("part", "block").cogroup(theirs.groupBy("part", "block")).applyInPandas(_pack, PLACED), "packed")

    left = placed.where("open").groupBy("container_name", "capacity", "part", "container").agg(F.sum("tokens").alias("tokens"))
    final = None  # of each container left open where its content is in the end
    for k, merged in enumerate(_rounds(left, parts), 1):
        step = merged.select("container_name", "part", "container", F.lit(k).alias("r"), "to_part", "to")
        if final is None:
            final = step
        else:
            later = step.select("container_name", F.lit(k - 1).alias("r"), F.col("part").alias("to_part"), F.col("container").alias("to"), F.lit(k).alias("_r"), F.col("to_part").alias("_p"), F.col("to").alias("_c"))
            both = final.join(later, ["container_name", "r", "to_part", "to"], "left")
            final = both.select("container_name", "part", "container", F.coalesce("_r", "r").alias("r"), F.coalesce("_p", "to_part").alias("to_part"), F.coalesce("_c", "to").alias("to"))
    label = F.concat_ws("-", F.lit(0), "part", "container")
    if final is not None:
        placed = placed.join(final.hint("merge"), ["container_name", "part", "container"], "left")  # numbers compress well, so their size on the way says little of that in memory
        label = F.coalesce(F.when(F.col("r").isNotNull(), F.concat_ws("-", "r", "to_part", "to")), label)
    return placed.select("container_name", label.alias("container_id"), "doc_id", "piece", "first_token", "tokens")


def pack_documents(documents: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """:func:`pack` for texts, sized in tokens of a public tokenizer."""
    return pack(stage(token_counts(documents, tokenizer, pattern), "tokens"), containers)


def fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: ``container_name, containers, tokens, share`` of the capacity in use."""
    each = packed.groupBy("container_name").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    kinds = containers.groupBy("container_name").agg(F.max("capacity_tokens").alias("capacity"))
    return each.join(kinds, "container_name").select("container_name", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("share"))


def checked(packed: DataFrame, sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind whether a packing is sound: ``container_name, documents, over, lost, divided``.

    ``documents`` that are in it, containers ``over`` their capacity, documents of whose tokens some are ``lost`` or
    twice there, and documents ``divided`` although they don't exceed the capacity.
    """
    kinds = containers.groupBy("container_name").agg(F.max("capacity_tokens").alias("capacity"))
    full = packed.groupBy("container_name", "container_id").agg(F.sum("tokens").alias("n")).join(kinds, "container_name").groupBy("container_name").agg(F.count_if(F.col("n") > F.col("capacity")).alias("over"))
    one = sizes.groupBy("doc_id").agg(F.sum("tokens").alias("whole"), F.max("tokens").alias("largest"))
    end = F.col("first_token") + F.col("tokens")
    per = packed.groupBy("container_name", "doc_id").agg(F.sum("tokens").alias("n"), F.max(end).alias("end"), F.max("piece").alias("pieces")).join(one, "doc_id").join(kinds, "container_name")
    wrong = (F.col("n") != F.col("whole")) | (F.col("end") != F.col("largest"))
    found = per.groupBy("container_name").agg(F.count("*").alias("documents"), F.count_if(wrong).alias("lost"), F.count_if((F.col("pieces") > 0) & (F.col("largest") <= F.col("capacity"))).alias("divided"))
    return found.join(full, "container_name").select("container_name", "documents", "over", "lost", "divided")
