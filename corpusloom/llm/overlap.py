"""Evaluation records that stand, exactly or almost, in the training split."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrow import batch, strings
from corpusloom.llm.homoglyphs import digest
from corpusloom.llm.sketch import pair_frequencies, slots
from corpusloom.llm.textform import PAIR_BITS, distinct_of, distinct_pairs, hashed_words, pairs_of_words, words
from corpusloom.plans.stages import checkpointed

LIKENESS = 0.6
SHARED = 3  # rare passages that a pair must share before it is compared in full
SHARD = 8_000_000  # characters of the evaluation texts in one automaton
TEXTS = 32_000_000  # characters of training texts that are scanned before the next automaton's turn
RUN = 8  # words in a row that count as a matched interval


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, names, norm = [], [], []
        for k, t in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
            w = words(t)
            if w:
                line = " ".join(w)
                keys.append(k)
                names.append(digest(line))
                norm.append(line)
        yield batch(key=pa.array(keys, pa.int64()), name=pa.array(names, pa.binary()), norm=pa.array(norm, pa.string()))


def normalised(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, norm): words joined by single spaces, and their digest; texts without words are left out."""
    rows = df.select(F.col(key).cast("long"), F.col(text)).filter(f"{key} is not null and {text} is not null")
    return rows.mapInArrow(_normalised, "key long, name binary, norm string")


def rare_first(pairs: np.ndarray, owner: np.ndarray, n: int, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs reordered, within each owner, rarest first; their owners and positions."""
    order = np.lexsort((pairs, frequency[slots(pairs)], owner))
    pairs, owner = pairs[order], owner[order]
    sizes = np.bincount(owner, minlength=n)
    return pairs, owner, np.arange(len(pairs)) - (np.cumsum(sizes) - sizes)[owner]


def passages_needed(size: np.ndarray, likeness: float, shared: int) -> np.ndarray:
    """How many of its rarest pairs a text must offer so that any text of that likeness holds ``shared`` of them."""
    return size - np.ceil(likeness * size - 1e-9).astype(np.int64) + shared


class EvaluationShard:
    """An automaton over the word pairs of some evaluation texts that like texts, or matched runs, can't avoid."""

    def __init__(self, norms: list[str], frequency: np.ndarray, likeness: float, shared: int, run: int | None = RUN):
        self.likeness, self.shared, self.norms, self.run = likeness, shared, norms, run
        self.words, self.start = hashed_words(norms)
        every, text = pairs_of_words(self.words, self.start)
        self.pairs, self.owner = distinct_of(every, text)
        self.size = np.bincount(self.owner, minlength=len(norms))
        self.keys = (self.owner.astype(np.uint64) << np.uint64(PAIR_BITS)) | self.pairs
        p, o, at = rare_first(self.pairs, self.owner, len(norms), frequency)
        offered = at < passages_needed(self.size, likeness, shared)[o]
        # of every ``run`` words in a row the rarest pair: a matched run holds one of them
        first_word = self.start[text] + np.arange(len(every)) - np.searchsorted(text, text)
        order = np.empty(len(every), np.int64)
        order[np.lexsort((every, frequency[slots(every)]))] = np.arange(len(every))
        anchor = np.zeros(len(every), bool)
        if run is not None and len(every) >= run - 1:
            rarest = np.lib.stride_tricks.sliding_window_view(order, run - 1).argmin(1) + np.arange(len(every) - run + 2)
            anchor[rarest[text[: len(rarest)] == text[run - 2 :]]] = True
        value, number = np.unique(np.concatenate([p[offered], every[anchor]]), return_inverse=True)
        self.value = value
        self.posting, self.posting_start = self._postings(number[: offered.sum()], o[offered], len(value))
        self.places, self.places_start = self._postings(number[offered.sum() :], first_word[anchor], len(value))
        self.automaton = ahocorasick.Automaton()
        # where each passage stands first tells its words; different passages of one hash are all looked for
        wanted = np.minimum(np.searchsorted(value, every), max(len(value) - 1, 0)) if len(value) else np.empty(0, np.int64)
        known = np.flatnonzero(value[wanted] == every) if len(value) else wanted
        at = first_word[known]
        _, one = np.unique(self.words[at] * np.uint64(0x9E3779B97F4A7C15) + self.words[at + 1], return_index=True)
        one = known[np.sort(one)]
        last, parts = -1, []
        for t, k, p_ in zip(text[one].tolist(), wanted[one].tolist(), (first_word[one] - self.start[text[one]]).tolist(), strict=True):
            if t != last:
                last, parts = t, norms[t].split(" ")
            self.automaton.add_word(f" {parts[p_]} {parts[p_ + 1]} ", k)
        if len(self.automaton):
            self.automaton.make_automaton()

    @staticmethod
    def _postings(number: np.ndarray, what: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(number, kind="stable")
        return what[order], np.searchsorted(number[order], np.arange(n + 1))

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, passage), distinct: which passages the automaton finds in which texts."""
        hit_text, hit_passage = [], []
        for n, t in enumerate(texts if len(self.automaton) else ()):
            found = {k for _, k in self.automaton.iter(f" {t} ")}
            hit_passage.extend(found)
            hit_text.extend([n] * len(found))
        return np.array(hit_text, np.int64), np.array(hit_passage, np.int64)

    def intervals(self, texts: list[str], text: np.ndarray, passage: np.ndarray, step: int = 2_000_000) -> np.ndarray:
        """(evaluation text, first word, word after the last), distinct: runs of at least ``run`` words that a text shares, as long as they can be."""
        words_, start = hashed_words(texts)
        pairs, owner = pairs_of_words(words_, start)
        at = start[owner] + np.arange(len(pairs)) - np.searchsorted(owner, owner)
        k = np.minimum(np.searchsorted(self.value, pairs), max(len(self.value) - 1, 0))
        known = np.zeros(len(pairs), bool) if not len(self.value) else (self.value[k] == pairs) & np.isin(owner * (len(self.value) + 1) + k, text * (len(self.value) + 1) + passage)
        at, k = at[known], k[known]
        n = (self.places_start[1:] - self.places_start[:-1])[k]
        load = np.concatenate([[0], np.cumsum(n)])
        bounds = np.repeat(start[1:], np.diff(start)), np.repeat(start[:-1], np.diff(start))
        mine = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        out = [np.empty((0, 3), np.int64)]
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(load, load[first] + step, "right")) - 1)
            c = n[first:last]
            a = np.repeat(at[first:last], c)
            e = self.places[np.repeat(self.places_start[k[first:last]], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
            first = last
            text_low, text_high, low, high = bounds[1][a], bounds[0][a], self.start[mine[e]], self.start[mine[e] + 1]
            left, right = np.zeros(len(a), np.int64), np.full(len(a), 2, np.int64)
            live = np.arange(len(a))
            while len(live):  # as far back as both texts agree
                i, j = a[live] - left[live] - 1, e[live] - left[live] - 1
                good = (i >= text_low[live]) & (j >= low[live])
                good[good] = words_[i[good]] == self.words[j[good]]
                live = live[good]
                left[live] += 1
            live = np.arange(len(a))
            while len(live):
                i, j = a[live] + right[live], e[live] + right[live]
                good = (i < text_high[live]) & (j < high[live])
                good[good] = words_[i[good]] == self.words[j[good]]
                live = live[good]
                right[live] += 1
            long = left + right >= self.run
            r = mine[e[long]]
            out.append(np.unique(np.stack([r, (e - left)[long] - self.start[r], (e + right)[long] - self.start[r]], 1), axis=0))
        return np.unique(np.concatenate(out), axis=0)

    def matches(self, texts: list[str], text: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(training text, evaluation text, likeness) of all pairs that are like enough."""
        nothing = np.empty(0, np.int64)
        if not len(passage):
            return nothing, nothing, nothing.astype(float)
        n = (self.posting_start[1:] - self.posting_start[:-1])[passage] if len(passage) else nothing
        # pieces, so that very common passages don't fill the memory
        results = []
        pairs, owner = distinct_pairs(texts)
        size = np.bincount(owner, minlength=len(texts))
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        load = np.concatenate([[0], np.cumsum(n)])
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(load[bounds], load[bounds[first]] + 4_000_000, "right")) - 1)
            last = min(last, len(texts))
            here = slice(bounds[first], bounds[last])
            results.append(self._compared(text[here], passage[here], n[here], pairs, owner, size))
            first = last
        return tuple(np.concatenate(x) for x in zip(*results, strict=True))

    def _compared(self, text, passage, n, pairs, owner, size):
        record = self.posting[np.repeat(self.posting_start[passage], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        proposed, times = np.unique((np.repeat(text, n) << 32) | record, return_counts=True)
        t, r = proposed >> 32, proposed & 0xFFFFFFFF
        low, high = np.minimum(size[t], self.size[r]), np.maximum(size[t], self.size[r])
        # a short text can't offer as many passages as are asked of a long one
        good = (times >= np.minimum(self.shared, np.ceil(self.likeness * high - 1e-9))) & (low >= self.likeness * high - 1e-9)
        t, r = t[good], r[good]
        start = np.searchsorted(owner, t)
        count = size[t]
        which = np.repeat(np.arange(len(t)), count)
        theirs = pairs[np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        wanted = (r[which].astype(np.uint64) << np.uint64(PAIR_BITS)) | theirs
        at = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
        both = np.bincount(which[self.keys[at] == wanted], minlength=len(t)) if len(t) else np.empty(0, np.int64)
        like = both / np.maximum(size[t] + self.size[r] - both, 1)
        good = both >= self.likeness * (size[t] + self.size[r] - both) - 1e-9
        return t[good], r[good], like[good]


def evaluation_shards(classes: DataFrame, shard: int) -> list:
    """(token, broadcast of names and norms) of the evaluation texts, in shards of about ``shard`` characters; the driver holds one at a time."""
    sc = classes.sparkSession.sparkContext
    total = classes.agg(F.sum(F.length("norm"))).first()[0] or 0
    n = -(-total // shard)
    of = F.pmod(F.xxhash64("name"), F.lit(n))
    out = []
    for k in range(n):
        t = classes.filter(of == k).select("name", "norm").toArrow()
        out.append((uuid.uuid4().hex, sc.broadcast((t["name"].to_pylist(), t["norm"].to_pylist()))))
    return out


def cross_split_overlaps(evaluation: DataFrame, training: DataFrame, likeness: float = LIKENESS, shared: int = SHARED, shard: int = SHARD, texts: int = TEXTS, runs: bool = False) -> tuple[DataFrame, DataFrame]:
    """What the training records share with classes of evaluation texts, and those classes' members (key, name).

    Both inputs have (record_id, text); evaluation texts of equal words form one
    class, named by a digest.  (e, key, likeness) has the training records that are like
    a class; with ``runs`` (e, start, stop), in other rows, the words of it that stand in
    a row in a training record.  Evaluation classes are dealt to shards, each
    an automaton over the passages (word pairs) that a like text or a run can't
    avoid: the rarest ones, as many as the likeness demands, and the rarest of
    every ``RUN`` words.  The training texts are scanned once, where they lie, by all
    automata in turn; what shares enough rare passages is compared in full, so
    no pair of at least ``likeness`` is lost.  Texts of a single word have no
    pair and are like nothing.
    """
    ev = checkpointed(normalised(evaluation, "record_id", "text"))
    shards = evaluation_shards(ev.groupBy("name").agg(F.first("norm").alias("norm")), shard)
    rows = training.select(F.col("record_id").cast("long").alias("key"), "text").filter("record_id is not null and text is not null")
    frequency = pair_frequencies(rows.select("text")) if shards else np.zeros(1)
    counts = evaluation.sparkSession.sparkContext.broadcast(np.minimum(frequency, 2**31 - 1).astype(np.int32))

    def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[int]]]:
        held: dict[str, list[int]] = {}
        size = 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                line = " ".join(words(text))
                if line:
                    size += len(line) if line not in held else 0
                    held.setdefault(line, []).append(key)
            if size >= texts:
                yield held
                held, size = {}, 0
        if held:
            yield held

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusloom.llm.overlap import built  # the worker's own module, whose automaton outlives the task

        for held in portions(batches):
            lines, keys = list(held), list(held.values())
            for token, sent in shards:
                names, machine = sent.value[0], built(token, lambda sent=sent: EvaluationShard(sent.value[1], counts.value, likeness, shared, RUN if runs else None))
                text, passage = machine.hits(lines)
                x, r, like = machine.matches(lines, text, passage)
                n = np.array([len(keys[j]) for j in x], np.int64)
                yield batch(
                    e=pa.array([names[k] for k in np.repeat(r, n)], pa.binary()), key=pa.array([key for j in x for key in keys[j]], pa.int64()), likeness=np.repeat(like, n).astype(np.float64),
                    start=pa.nulls(int(n.sum()), pa.int64()), stop=pa.nulls(int(n.sum()), pa.int64()))
                if runs:
                    r, start, stop = machine.intervals(lines, text, passage).T
                    yield batch(e=pa.array([names[k] for k in r], pa.binary()), key=pa.nulls(len(r), pa.int64()), likeness=pa.nulls(len(r), pa.float64()), start=pa.array(start, pa.int64()), stop=pa.array(stop, pa.int64()))

    schema = "e binary, key long, likeness double, start long, stop long"
    found = rows.mapInArrow(scan, schema) if shards else evaluation.sparkSession.createDataFrame([], schema)
    return checkpointed(found.distinct()), ev.select("key", "name", (F.length("norm") - F.length(F.replace("norm", F.lit(" "))) + 1).alias("n_words"))


_machines: dict[str, EvaluationShard] = {}


def built(token: str, make) -> EvaluationShard:
    """The automaton of that name; a worker keeps one at a time."""
    if token not in _machines:
        _machines.clear()
        _machines[token] = make()
    return _machines[token]


def covered(found: DataFrame) -> DataFrame:
    """(e, covered): words of each class inside matched intervals, merged over all training texts."""
    w = Window.partitionBy("e").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    each = found.filter("start is not null").select("e", "start", "stop").withColumn("reached", F.coalesce(F.max("stop").over(w), F.lit(0)))
    return each.groupBy("e").agg(F.sum(F.greatest(F.col("stop") - F.greatest("start", "reached"), F.lit(0))).alias("covered"))


def overlap_pairs(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """(record_id, train_record_id) with a likeness of at least 0.60."""
    found, ev = cross_split_overlaps(evaluation, training)
    return found.join(ev.select(F.col("name").alias("e"), F.col("key").alias("record_id")), "e").select("record_id", F.col("key").alias("train_record_id")).distinct()


def overlap_report(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """Per split and source: records, those with a like training record, exact ones, pairs with training records, and the mean share of words in matched intervals.

    The share counts words that stand, ``RUN`` or more in a row, in any training
    record; it is averaged over records with words.  A record_id that comes
    several times counts with each of its texts' classes.
    """
    found, ev = cross_split_overlaps(evaluation, training, runs=True)
    like = found.filter("key is not null").groupBy("e").agg(F.countDistinct("key").alias("training"), F.max((F.col("likeness") == 1).cast("long")).alias("exact"))
    classes = ev.select("name", "n_words").distinct().join(like.withColumnRenamed("e", "name"), "name", "left").join(covered(found).withColumnRenamed("e", "name"), "name", "left")
    of = ev.select(F.col("key").alias("record_id"), "name").distinct().join(classes, "name")
    per = of.groupBy("record_id").agg(F.sum("training").alias("training"), F.max("exact").alias("exact"), F.max(F.coalesce("covered", F.lit(0)) / F.col("n_words")).alias("cover"))
    rows = evaluation.select("record_id", "split", F.coalesce("source", F.lit("(none)")).alias("source")).distinct()
    return (
        rows.join(per, "record_id", "left").groupBy("split", "source")
        .agg(F.count("*").alias("n_records"), F.count("training").alias("n_overlapping"), F.coalesce(F.sum("exact"), F.lit(0)).alias("n_exact"),
             F.coalesce(F.sum("training"), F.lit(0)).alias("n_training_pairs"), F.round(F.avg("cover"), 6).alias("mean_coverage"))
    )
