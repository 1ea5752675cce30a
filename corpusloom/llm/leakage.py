"""Held-out passages inside a training corpus: multi-pattern search on words with block shifts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import batch, strings
from corpusloom.llm.textform import hashed_words, mix

SPAN = 12  # words that must stand in a row
BLOCK = 2  # words of the block that looks up a shift
CHUNK = 512  # words that one cursor scans


def block_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) ^ ((b << np.uint64(29)) | (b >> np.uint64(35))))


class PassageSearch:
    """All windows of ``span`` words of some items, searched in many texts at once.

    A table over hashed two-word blocks says how far a window's end lies
    beyond the block at least; a cursor whose block has shift 0 looks up the
    windows that end in that block and compares them word by word.  Many
    cursors advance together, each over its own stretch of text.
    """

    def __init__(self, item_words: np.ndarray, item_start: np.ndarray, span: int = SPAN, bits: int = 20):
        self.span, self.bits = span, bits
        lengths = np.diff(item_start)
        owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths - span + 1, 0))
        first = np.concatenate([np.arange(s, s + n - span + 1) for s, n in zip(item_start[:-1], lengths, strict=True)] or [np.empty(0, int)]).astype(np.int64)
        windows = item_words[first[:, None] + np.arange(span)] if len(first) else np.empty((0, span), np.uint64)
        code = block_codes(windows[:, -2], windows[:, -1])
        order = np.argsort(code, kind="stable")
        self.windows, self.owner, self.suffix = windows[order], owner[order], code[order]
        most = span - BLOCK + 1
        self.shift = np.full(1 << bits, most, np.int64)
        for j in range(most):  # nearest ends last, so the smallest shift stays
            c = block_codes(windows[:, j], windows[:, j + 1]) >> np.uint64(64 - bits)
            self.shift[c] = np.minimum(self.shift[c], most - 1 - j)

    def found(self, words: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, item) numbers; ``start`` are the offsets of the texts in ``words``."""
        span = self.span
        texts, items = [], []
        lengths = np.diff(start)
        pieces = np.maximum(-(-(lengths - span + 1) // CHUNK), 0)
        text = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        end = start[:-1][text] + nth * CHUNK + span - 1  # the last word of the first window
        stop = np.minimum(end + CHUNK, start[1:][text])
        while len(end):
            code = block_codes(words[end - 1], words[end])
            step = self.shift[(code >> np.uint64(64 - self.bits)).astype(np.int64)]
            hit = np.flatnonzero(step == 0)
            if len(hit) and len(self.suffix):
                lo, hi = np.searchsorted(self.suffix, code[hit], "left"), np.searchsorted(self.suffix, code[hit], "right")
                n = hi - lo
                pattern = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(hit, n)
                same = words[end[at] - span + 1] == self.windows[pattern, 0]
                at, pattern = at[same], pattern[same]
                same = (words[end[at][:, None] + np.arange(1 - span, 1)] == self.windows[pattern]).all(1)
                texts.append(text[at[same]])
                items.append(self.owner[pattern[same]])
            end = end + np.maximum(step, 1)
            live = end < stop
            end, stop, text = end[live], stop[live], text[live]
        if not texts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.stack([np.concatenate(texts), np.concatenate(items)]), axis=1)
        return both[0], both[1]


def leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", span: int = SPAN, block_words: int = 400_000, portion_words: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id): at least ``span`` consecutive words of the item stand in the document.

    Items are read in blocks of ``block_words`` words, the bound of one search
    table; the documents are scanned once, and each portion of them is searched for
    one block after the other, its words hashed once.  Texts
    that are NULL, blank or shorter than ``span`` words hold and give nothing.
    Repeated documents and items give distinct rows.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_key).cast("long"), F.col(text)).filter(f"{doc_key} is not null and {text} is not null")
    held = items.select(F.col(item_key).cast("long").alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null").distinct()
    total = held.agg(F.sum(F.length("text"))).first()[0] or 0
    ways = -(-(total // 5 + 1) // block_words)
    blocks = []
    for k in range(ways):  # the driver holds one block at a time
        t = held.filter(F.pmod(F.xxhash64("key", "text"), F.lit(ways)) == k).toArrow()
        if t.num_rows:
            blocks.append((uuid.uuid4().hex, spark.sparkContext.broadcast((t["key"].to_pylist(), t["text"].to_pylist()))))
    if not blocks:
        return spark.createDataFrame([], "doc_id long, item_id long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusloom.llm.leakage import built  # the worker's own module, whose tables outlive the task

        for keys, hashed in _portions(batches, portion_words):
            for token, block in blocks:
                names, machine = built(token, lambda block=block: (np.array(block.value[0], np.int64), PassageSearch(*hashed_words(block.value[1]), span=span)))
                doc, item = machine.found(*hashed)
                yield batch(doc_id=keys[doc], item_id=names[item])

    return docs.mapInArrow(search, "doc_id long, item_id long").distinct()


def _portions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """(keys, (word hashes, starts)) of about ``most`` words; longer texts stay whole."""
    keys: list[np.ndarray] = []
    parts: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    size = 0

    def joined():
        return np.concatenate(keys), (np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))]))

    for b in batches:
        h, start = hashed_words(strings(b.column(1)))
        keys.append(b.column(0).to_numpy())
        parts.append(h)
        counts.append(np.diff(start))
        size += len(h)
        if size >= most:
            yield joined()
            keys, parts, counts, size = [], [], [], 0
    if keys:
        yield joined()


_tables: dict[str, tuple] = {}


def built(token: str, make) -> tuple:
    """The search table of that name; a worker keeps one at a time."""
    if token not in _tables:
        _tables.clear()
        _tables[token] = make()
    return _tables[token]


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item that leaked: item_id, suite, and in how many documents of how many sources."""
    pairs = leaks(documents, items)
    where = documents.select("doc_id", "source").dropDuplicates(["doc_id"])
    suites = items.groupBy("item_id").agg(F.min("suite").alias("suite"))
    return (
        pairs.join(where, "doc_id", "left").groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.countDistinct("source").alias("n_sources"))
        .join(suites, "item_id").select("item_id", "suite", "n_documents", "n_sources")
    )
