"""Filling containers of fixed capacity: dominance reduction on a size histogram, then best fit.

All decisions depend only on how many items there are of each size, so the
driver works on a table of at most ``capacity`` rows and returns a plan of
container patterns; which item goes where follows from its rank among the
items of its size.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import batch, strings
from corpusloom.llm.ranking import ranked
from corpusloom.plans.stages import checkpointed

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The split pattern that belongs to the public vocabulary; a fixed value.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, size): tokens of each text; NULL and empty texts have none and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for b in batches:
            sizes = np.array([len(e.encode_ordinary(t)) for t in strings(b.column(1))], np.int64)
            some = sizes > 0
            yield batch(key=b.column(0).to_numpy()[some], size=sizes[some])

    return df.select(F.col(key).cast("long"), F.col(text)).filter(f"{key} is not null and {text} is not null").mapInArrow(run, "key long, size long")


class Stock:
    """How many items of each size are left, with their sizes in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def largest(self, room: int, aside: dict[int, int] | None = None) -> int:
        """Largest size of at most ``room`` of which more is left than set ``aside``; 0 if none."""
        at = bisect.bisect_right(self.sizes, room) - 1
        while at >= 0:
            s = self.sizes[at]
            if not aside or self.count[s] > aside.get(s, 0):
                return s
            at -= 1
        return 0

    def above(self, size: int) -> int:
        """Smallest size beyond ``size``; 0 if none."""
        at = bisect.bisect_right(self.sizes, size)
        return self.sizes[at] if at < len(self.sizes) else 0

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if self.count[size] == 0:
            del self.count[size]
            del self.sizes[bisect.bisect_left(self.sizes, size)]

    def smallest(self, aside: int) -> list[int]:
        """The three smallest items left, one of size ``aside`` not counted."""
        out: list[int] = []
        for s in self.sizes[:4]:
            out += [s] * min(3, self.count[s] - (s == aside))
        return out[:3]


def reduced(stock: Stock, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello and Toth's reduction: sets that dominate every other set of their largest item are fixed.

    Largest sizes first.  An item that nothing fits beside is alone.  An item
    and the largest one that fits beside it dominate if together they fill the
    container, or if no two items fit beside the first.  If at most two fit, the
    largest one and a partner that fills the rest dominate, provided no two items
    larger than the partner fit beside the first.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    for j in sorted(stock.sizes, reverse=True):
        while stock.count.get(j, 0) > 0:
            room, left = capacity - j, stock.count[j]
            k = stock.largest(room, {j: 1})
            if k == 0:
                fixed.append(((j,), left))
                stock.take(j, left)
                continue
            low = stock.smallest(j)
            if j + k == capacity or len(low) < 2 or low[0] + low[1] > room:
                n = left // 2 if j == k else min(left, stock.count[k])
                fixed.append(((j, k), n))
                stock.take(j, 2 * n if j == k else n)
                if j != k:
                    stock.take(k, n)
                continue
            if len(low) == 3 and sum(low) <= room:
                break
            aside = {j: 1}
            aside[k] = aside.get(k, 0) + 1
            a = stock.largest(room - k, aside)
            next_up = stock.above(a)
            if a == 0 or a != room - k or (next_up and 2 * next_up <= room):
                break
            need = {s: (j, k, a).count(s) for s in (j, k, a)}
            n = min(stock.count[s] // m for s, m in need.items())
            fixed.append(((j, k, a), n))
            for s, m in need.items():
                stock.take(s, m * n)
    return fixed


def best_fit(stock: Stock, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit on counts: largest items first, each into the container with the least room that it fits in, a new one if there is none.

    Containers of equal content are one entry.  A container that still has room
    for another item of the same size has less room than before, so it is the
    next one's best fit, too.
    """
    room: dict[int, list[list]] = {}  # room -> [content, number of containers]
    rooms: list[int] = []

    def put(content: tuple[int, ...], left: int, n: int) -> None:
        if left not in room:
            bisect.insort(rooms, left)
            room[left] = []
        room[left].append([content, n])

    for size in sorted(stock.sizes, reverse=True):
        n = stock.count[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            left = rooms[at] if at < len(rooms) else capacity
            content, containers = room[left].pop() if at < len(rooms) else ((), n)
            each = left // size
            full = min(containers, n // each)
            if full:
                put(content + (size,) * each, left - each * size, full)
                n -= full * each
            some = n if full < containers else 0  # fewer items than fill one more container
            if some:
                put(content + (size,) * some, left - some * size, 1)
                n = 0
            rest = containers - full - bool(some)
            if rest and at < len(rooms) and left in room:
                room[left].append([content, rest])
            for r in (left,):
                if r in room and not room[r]:
                    del room[r]
                    rooms.remove(r)
        stock.take(size, stock.count[size])
    return [(content, n) for r in rooms for content, n in room[r]]


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(sizes, number of containers with just these): reduction first, best fit for the rest."""
    stock = Stock(counts)
    return reduced(stock, capacity) + best_fit(stock, capacity)


def slots_of(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """(size, first rank, first container, position): where the ranks of each size go.

    The ``m`` items of one size in a container take ``m`` rank ranges, one per position.
    """
    used: dict[int, int] = {}
    rows, container = [], 0
    for content, n in plan:
        for position, size in enumerate(content):
            rows.append((size, used.get(size, 0), container, position))
            used[size] = used.get(size, 0) + n
        container += n
    return rows


def packed_items(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, position, key, piece, size): every item in exactly one container.

    ``items`` has (key, size).  An item larger than the capacity is cut into
    full containers (pieces 0, 1, ...) and a last piece that is packed like any
    other; all others stay whole.  Sizes below 1 and NULL sizes are left out; equal
    keys are items of their own.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    cut = items.filter("key is not null and size >= 1").select(
        "key", F.explode(F.expr(f"transform(sequence(0L, (size - 1) div {capacity}), p -> struct(p as piece, least({capacity}, size - p * {capacity}) as size))")).alias("x")
    ).select("key", "x.piece", "x.size")
    cut = checkpointed(cut)
    counts = {r["size"]: r["n"] for r in cut.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    rows = np.array(sorted(slots_of(packing_plan(counts, capacity))) or [(-1, 0, 0, 0)], np.int64)
    sent = items.sparkSession.sparkContext.broadcast(rows)  # as large as the plan, which sizes alone decide

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_, first, container, position = sent.value.T
        keys = (size_ << 44) | first
        for b in batches:
            t = pa.table(b)
            rank, size = t["rank"].to_numpy(), t["size"].to_numpy()
            at = np.searchsorted(keys, (size << 44) | rank, "right") - 1
            yield batch(sequence_id=container[at] + rank - first[at], position=position[at], key=t["key"].combine_chunks(), piece=t["piece"].combine_chunks(), size=size)

    numbered = ranked(cut.withColumn("order", F.xxhash64("key", "piece")), "size", ["order", "key", "piece"])
    return numbered.mapInArrow(place, "sequence_id long, position long, key long, piece long, size long")


def packed_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(sequence_id, position, doc_id, piece, n_tokens): the content of each training sequence."""
    return packed_items(token_counts(documents, "doc_id", "text", tokenizer), capacity).select(
        "sequence_id", "position", F.col("key").alias("doc_id"), "piece", F.col("size").alias("n_tokens")
    )
