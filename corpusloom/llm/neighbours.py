"""Most similar vectors: collision counting over sorted projections, within cells.

Every cell keeps, for each of some random projections, the sorted array of its
vectors.  A query's window in an array reaches as far as vectors within the
search radius fall with high probability; a larger radius widens the windows
(virtual rehashing).  Vectors that fall into enough windows are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrow import batch
from corpusloom.llm.vectors import Cells, dealt, matrix, members, names, packed, sampled, source, unit, unpacked
from corpusloom.plans.stages import checkpointed

PROJECTIONS, COLLISIONS, REACH = 36, 24, 1.5  # windows of 1.5 standard deviations: a pair at the radius collides in 87 of 100
STEPS = 64  # of each sorted array; windows are rounded outward to them
BLOCK = 32_768  # vectors of one block of a large cell


class Windows:
    """Sorted projections of some vectors.

    Of every sorted array, the set of vectors below each of ``STEPS`` ranks is
    kept as a row of bits, so a window is the difference of two rows, and
    collisions are added up for 64 vectors at once.
    """

    CHUNK = 4096  # vectors whose bits lie together
    FULL = 1 << COLLISIONS.bit_length()  # counters start at FULL - COLLISIONS, so that enough collisions reach the bit of FULL

    def __init__(self, x: np.ndarray, seed: int = 5):
        self.x = x
        self.axes = np.random.default_rng(seed).standard_normal((x.shape[1], PROJECTIONS)).astype(np.float32)
        value = x @ self.axes
        self.array = np.sort(value, 0)
        n = len(x)
        chunks = -(-n // self.CHUNK)
        self.below = np.zeros((chunks, PROJECTIONS, STEPS + 1, self.CHUNK // 8), np.uint8)
        steps = np.arange(STEPS + 1)[:, None]
        for i in range(PROJECTIONS):
            at = np.searchsorted(self.array[:, i], value[:, i]) * STEPS // max(n, 1)
            for c in range(chunks):
                bits = np.packbits(at[None, c * self.CHUNK : (c + 1) * self.CHUNK] < steps, axis=1, bitorder="little")
                self.below[c, i, :, : bits.shape[1]] = bits
        self.below = self.below.view(np.uint64)

    def windows(self, value: np.ndarray, half: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First step, and the step after the last one, of the query-centred window in each array."""
        n = len(self.x)
        low, high = np.empty(value.shape[::-1], np.int64), np.empty(value.shape[::-1], np.int64)
        for i in range(PROJECTIONS):
            a, b = np.searchsorted(self.array[:, i], value[:, i] - half, "left"), np.searchsorted(self.array[:, i], value[:, i] + half, "right")
            # equal values share the step of the first of them
            low[i] = np.minimum(a, n - 1) * STEPS // n
            high[i] = np.where(b > a, np.maximum(b - 1, 0) * STEPS // n + 1, low[i])
        return low, high

    def candidates(self, value: np.ndarray, radius: float | np.ndarray, after: bool = False, tile: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, vector) pairs that collide in at least ``COLLISIONS`` windows; ``after``: the queries are the vectors, and only pairs in rising order count."""
        if not len(self.x) or not len(value):
            return
        low, high = self.windows(value, REACH * radius)
        words = self.CHUNK // 64
        start = self.FULL - COLLISIONS
        buffers = [np.empty((min(tile, len(value)), words), np.uint64) for _ in range(3 * self.FULL.bit_length() + 4)]
        for q in range(0, len(value), tile):
            stop = min(q + tile, len(value))
            for chunk in range(q // self.CHUNK if after else 0, len(self.below)):
                spare = [b[: stop - q] for b in buffers]
                waiting: list[list[np.ndarray]] = [[] for _ in range(self.FULL.bit_length())]  # by weight: 1, 2, 4, ...
                for w in range(len(waiting)):
                    if start >> w & 1:
                        waiting[w].append(spare.pop())
                        waiting[w][0].fill(np.uint64(0xFFFFFFFFFFFFFFFF))
                for i in range(PROJECTIONS):
                    inside, beyond = spare.pop(), spare.pop()
                    np.take(self.below[chunk, i], high[i, q:stop], axis=0, out=inside, mode="clip")
                    np.take(self.below[chunk, i], low[i, q:stop], axis=0, out=beyond, mode="clip")
                    waiting[0].append(np.bitwise_xor(inside, beyond, out=inside))
                    spare.append(beyond)
                    w = 0
                    while w < len(waiting) - 1 and len(waiting[w]) == 3:  # three of a weight make one of it and one of twice the weight
                        a, b, c = waiting[w]
                        odd = np.bitwise_xor(a, b, out=spare.pop())
                        np.bitwise_and(a, b, out=a)
                        waiting[w + 1].append(np.bitwise_or(a, np.bitwise_and(odd, c, out=b), out=a))
                        waiting[w] = [np.bitwise_xor(odd, c, out=odd)]
                        spare += [b, c]
                        w += 1
                for w in range(len(waiting) - 1):
                    while len(waiting[w]) > 1:
                        a, b = waiting[w].pop(), waiting[w].pop()
                        waiting[w].append(a ^ b)
                        waiting[w + 1].append(a & b)
                enough = waiting[-1][0]
                for other in waiting[-1][1:]:
                    enough = enough | other
                row, word = np.nonzero(enough)
                left = enough[row, word]
                while len(left):  # the lowest bit of each word; few words have several
                    rest = left & (left - np.uint64(1))
                    at = chunk * self.CHUNK + word * 64 + np.bitwise_count((left ^ rest) - np.uint64(1))
                    good = (at > row + q if after else True) & (at < len(self.x))
                    yield (row + q)[good], at[good]
                    more = rest != 0
                    left, row, word = rest[more], row[more], word[more]


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows of x and y in double precision, rounded so that equal directions tie."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    return np.round((x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)), 9)


def verified(found: Iterator[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, raw: np.ndarray, floor: np.ndarray, own: np.ndarray | None = None, step: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the candidates that reach their query's floor; a query's own row is passed over."""
    q, x = unit(queries), unit(raw)
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for a, b in found:
        for k in range(0, len(a), step):
            i, j = a[k : k + step], b[k : k + step]
            good = np.einsum("ij,ij->i", q[i], x[j]) >= floor[i] - 1e-4
            if own is not None:
                good &= own[i] != j
            i, j = i[good], j[good]
            cos = exact(queries[i], raw[j])
            good = cos >= floor[i] - 1e-9
            out.append((i[good], j[good], cos[good]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def best_of(i: np.ndarray, j: np.ndarray, cos: np.ndarray, key: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``take`` best rows of each query; of equal cosines the smaller ``key`` goes first."""
    order = np.lexsort((key[j], -cos, i))
    i, j, cos = i[order], j[order], cos[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < take], j[rank < take], cos[rank < take]


def within_radius(w: Windows, raw: np.ndarray, queries: np.ndarray, key: np.ndarray, own: np.ndarray, take: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine): the ``take`` best rows of each query among those that reach its floor."""
    radius = np.sqrt(np.maximum(2 - 2 * floor, 1e-9))
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for k in range(0, len(queries), 256):
        part = slice(k, k + 256)
        i, j, cos = best_of(*verified(w.candidates(unit(queries[part]) @ w.axes, radius[part]), queries[part], raw, floor[part], own[part]), key, take)
        out.append((i + k, j, cos))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def best_lists(raw: np.ndarray, home: np.ndarray, second: np.ndarray | None, key: np.ndarray, take: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine): for each row at home the ``take`` best other rows of at least ``floor``.

    ``second`` marks the second of two blocks; then only pairs between the
    blocks count.  Windows start at half the radius where most vectors have
    enough neighbours there, as a few of them show; those that haven't widen theirs to the
    whole radius (virtual rehashing).  Else they have the whole radius at once.
    """
    radius = float(np.sqrt(max(2 - 2 * floor, 1e-9)))
    x = unit(raw)
    a, b = (np.arange(len(x)), np.arange(len(x))) if second is None else (np.flatnonzero(~second), np.flatnonzero(second))
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    some = a[:: max(1, len(a) // 64)]
    crowded = ((x[some] @ x[b].T >= 1 - radius * radius / 8).sum(1) > take).mean() > 0.5
    w = Windows(x[b])

    def pairs(r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        least = np.full(len(a), max(floor, 1 - r * r / 2))
        i, j, cos = verified(w.candidates(x[a] @ w.axes, r, after=second is None), raw[a], raw[b], least)
        i, j = a[i], b[j]
        i, j, cos = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([cos, cos])
        return best_of(i[home[i]], j[home[i]], cos[home[i]], key, take)

    i, j, cos = pairs(radius / 2 if crowded else radius)
    if crowded:
        live = home & (np.bincount(i, minlength=len(x)) < take)
        keep = ~live[i]
        out = [(i[keep], j[keep], cos[keep])]
        for queries, rows in ((a, b),) if second is None else ((a, b), (b, a)):
            q = queries[live[queries]]
            at = np.full(len(x), -1)
            at[rows] = np.arange(len(rows))
            wide = w if rows is b else Windows(x[rows])
            i, j, cos = within_radius(wide, raw[rows], raw[q], key[rows], at[q], take, np.full(len(q), floor))
            out.append((q[i], rows[j], cos))
        i, j, cos = (np.concatenate(c) for c in zip(*out, strict=True))
    return i, j, cos


def _distinct(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """One row per name: the table, whether a vector is at home, its smallest key seen, and the order of those keys."""
    name = t["name"].combine_chunks().dictionary_encode().indices.to_numpy()
    home, doc, sentence = t["at_home"].to_numpy(), t["doc_id"].to_numpy(), t["sentence_id"].to_numpy()
    order = np.lexsort((sentence, doc, ~home, name))
    first = order[np.concatenate([[True], np.diff(name[order]) != 0])]
    by_key = np.lexsort((sentence, doc, name))
    least = by_key[np.concatenate([[True], np.diff(name[by_key]) != 0])]
    rank = np.empty(len(least), np.int64)
    rank[np.lexsort((sentence[least], doc[least]))] = np.arange(len(least))
    return t.take(pa.array(first)), home[first], least, rank


def close_lists(rows: DataFrame, dim: int, floor: float, take: int, block: int = BLOCK) -> DataFrame:
    """(a, b, cosine, doc_id, sentence_id): for each distinct vector a its ``take`` most similar distinct ones of at least ``floor`` in each block, by name.

    The pivots are fitted to a bounded sample; all rows are indexed.  Copies of
    a vector are combined before the shuffle.  A large cell is cut into blocks,
    and each pair of blocks is one task.  The key is b's smallest one seen.
    """
    sample, total = sampled(rows, dim)
    cells = Cells(unit(sample), wide=True)
    turn = float(np.degrees(np.arccos(floor)))
    cuts = {c: max(1, int(np.ceil(s * total / block))) for c, s in cells.share.items()}
    sent = rows.sparkSession.sparkContext.broadcast((cells, cuts))  # at most PIVOTS vectors

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, cuts = sent.value
        seen: dict[bytes, tuple[int, int]] = {}
        for b in batches:
            at, x = matrix(b.column(2), dim)
            doc, sentence = b.column(0).to_numpy()[at], b.column(1).to_numpy()[at]
            packs = packed(x)
            name = names(packs)
            new = []
            for k, pair in enumerate(zip(name, zip(doc.tolist(), sentence.tolist(), strict=True), strict=True)):
                if pair[1] < seen.get(pair[0], (1 << 63, 0)):  # a copy goes out again only under a smaller key
                    new.append(k)
                    if len(seen) < 1_000_000:
                        seen[pair[0]] = pair[1]
            new = np.array(new, np.int64)
            x = unit(x[new])
            for cell, at_, at_home in cells.routes(x, turn, both_ways=True):
                if not len(at_):
                    continue
                g = cuts.get(cell, 1)
                here = new[at_]
                mine = dealt([name[k] for k in here], g)
                for other in range(g):
                    lo, hi = np.minimum(mine, other), np.maximum(mine, other)
                    yield batch(
                        cell=pa.array(np.full(len(here), cell), pa.int32()), low=pa.array(lo.astype(np.int32)), high=pa.array(hi.astype(np.int32)), mine=pa.array(mine.astype(np.int32)),
                        at_home=pa.array(np.full(len(here), at_home)), name=pa.array([name[k] for k in here], pa.binary()), doc_id=doc[here], sentence_id=sentence[here], vector=pa.array([packs[k] for k in here], pa.binary()),
                    )

    def lists(whole: pa.Table) -> pa.Table:
        t, home, least, rank = _distinct(whole)
        raw = unpacked(t["vector"], dim)
        mine, low, high = t["mine"].to_numpy(), t["low"][0].as_py(), t["high"][0].as_py()
        i, j, cos = best_lists(raw, home, mine == high if low != high else None, rank, take, floor)
        i, j = pa.array(i), pa.array(j)
        keys = whole.select(["doc_id", "sentence_id"]).take(pa.array(least)).take(j)
        return pa.table({"a": pc.take(t["name"], i), "b": pc.take(t["name"], j), "cosine": cos, "doc_id": keys["doc_id"], "sentence_id": keys["sentence_id"]})

    tasks = sum(g * (g + 1) // 2 for g in cuts.values())
    routed = rows.mapInArrow(route, "cell int, low int, high int, mine int, at_home boolean, name binary, doc_id long, sentence_id long, vector binary")
    # about as many partitions as pairs of blocks, so that few large ones fall together
    routed = routed.repartition(max(2 * tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "cell", "low", "high")
    return routed.groupBy("cell", "low", "high").applyInArrow(lists, "a binary, b binary, cosine double, doc_id long, sentence_id long")


def neighbour_pairs(df: DataFrame, dim: int = 96, k: int = 10, floor: float = 0.96) -> DataFrame:
    """(doc_id_a, sentence_id_a, doc_id_b, sentence_id_b), smaller key first.

    Pairs of usable vectors with a cosine of at least ``floor`` of which one is
    among the ``k`` most similar of the other; of equal cosines the smaller key
    goes first.  A vector is usable if it has ``dim`` finite components that
    aren't all zero; a key that comes several times counts once.  NULL keys and
    vectors are left out.  Equal vectors are compared once, and a class of
    copies only ever lists its first ``k + 1`` members as neighbours.  A class
    beyond the ``k + 1`` best ones, ranked by cosine and smallest key, has as many
    keys before it, so no task gives more than those of a vector.
    """
    rows = source(df)
    key_of = checkpointed(members(rows, dim))
    each = Window.partitionBy("a").orderBy(F.desc("cosine"), "doc_id", "sentence_id", "b")
    lists = close_lists(rows, dim, floor, k + 1)
    arcs = lists.withColumn("r", F.row_number().over(each)).filter(F.col("r") <= k + 1).select("a", "b", "cosine")
    arcs = checkpointed(arcs)
    first = Window.partitionBy("name").orderBy("doc_id", "sentence_id")
    heads = key_of.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    several = heads.filter("r = 2").select("name")
    arcs = arcs.union(several.select("name", "name", F.lit(1.0)))
    nearest = Window.partitionBy("a").orderBy(F.desc("cosine"), "doc_id", "sentence_id")
    listed = (
        arcs.join(heads.select(F.col("name").alias("b"), "doc_id", "sentence_id"), "b")
        .withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= k + 1)
        .select(F.col("a").alias("name"), F.col("doc_id").alias("d"), F.col("sentence_id").alias("s"), "r")
    )
    # a member may be in its own list; it is passed over, so the list of its class is one longer
    own = listed.join(key_of.withColumnsRenamed({"doc_id": "d", "sentence_id": "s"}), ["name", "d", "s"]).select("name", F.col("d").alias("doc_id"), F.col("s").alias("sentence_id"), F.col("r").alias("own"))
    listing = key_of.join(own, ["name", "doc_id", "sentence_id"], "left").join(listed, "name")
    mine = listing.filter((F.col("r") != F.coalesce("own", F.lit(0))) & (F.col("r") <= F.when(F.col("own").isNotNull(), k + 1).otherwise(k)))
    swap = (F.col("d") < F.col("doc_id")) | ((F.col("d") == F.col("doc_id")) & (F.col("s") < F.col("sentence_id")))
    return mine.select(
        F.when(swap, F.col("d")).otherwise(F.col("doc_id")).alias("doc_id_a"), F.when(swap, F.col("s")).otherwise(F.col("sentence_id")).alias("sentence_id_a"),
        F.when(swap, F.col("doc_id")).otherwise(F.col("d")).alias("doc_id_b"), F.when(swap, F.col("sentence_id")).otherwise(F.col("s")).alias("sentence_id_b"),
    ).distinct()


def rehashed_top(w: Windows, raw: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, radius: float = 0.2, growth: float = 1.5, part: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine): the k best rows of each query, by virtual rehashing.

    The windows of unfinished queries widen by ``growth`` until k verified rows
    lie within the radius, or the windows hold everything.  ``own`` has the row
    that is the query itself, -1 if there is none.  Queries are worked off in parts, which bounds the memory.
    """
    x, q = w.x, unit(queries)
    value = q @ w.axes
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first in range(0, len(q), part):
        live = np.arange(first, min(first + part, len(q)))
        r = radius
        while len(live):
            found = []
            for a, b in w.candidates(value[live], r):
                other = own[live[a]] != b
                a, b = a[other], b[other]
                found.append((a.astype(np.int32), b.astype(np.int32), np.concatenate([np.einsum("ij,ij->i", q[live[a[n : n + 200_000]]], x[b[n : n + 200_000]]) for n in range(0, len(a), 200_000)] or [np.empty(0, np.float32)])))
            a, b, cos = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.float32))
            order = np.lexsort((b, -cos, a))
            a, b, cos = a[order], b[order], cos[order]
            start = np.searchsorted(a, np.arange(len(live)))
            rank = np.arange(len(a)) - start[a]
            within = np.bincount(a[cos >= 1 - r * r / 2], minlength=len(live)) if len(a) else np.zeros(len(live), np.int64)
            done = (within >= k) | (r >= 2.0)
            keep = done[a] & (rank < k)
            i, j = live[a[keep]], b[keep].astype(np.int64)
            if len(i):
                out.append((i, j, exact(queries[i], raw[j])))
            live = live[~done]
            r *= growth
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _answers(rows: DataFrame, asked: DataFrame, cells: Cells, cuts: dict[int, int], dim: int, k: int, again: bool) -> DataFrame:
    """(doc_id, sentence_id, near_doc_id, near_sentence_id, cosine): the best rows of each query in each piece of the cells it is asked in.

    Every vector is stored in its home cell.  A query is asked at home, or with
    ``again`` in all other cells that can hold something at least as similar as ``bound``.
    """
    sent = rows.sparkSession.sparkContext.broadcast((cells, cuts))

    def part(at, cell, piece, query, doc, sentence, packs, bound):
        return batch(
            cell=pa.array(cell.astype(np.int32)), piece=pa.array(piece.astype(np.int32)), query=pa.array(np.full(len(at), query)), doc_id=doc[at], sentence_id=sentence[at],
            bound=pa.array(bound[at]), vector=pa.array([packs[i] for i in at], pa.binary()),
        )

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, cuts = sent.value
        for b in batches:
            at, raw = matrix(b.column(2), dim)
            doc, sentence = b.column(0).to_numpy()[at], b.column(1).to_numpy()[at]
            packs = packed(raw)
            home = cells.home(unit(raw))
            piece = dealt(names(packs), np.array([cuts.get(int(c), 1) for c in home], np.uint32))
            yield part(np.arange(len(home)), home, piece, False, doc, sentence, packs, np.zeros(len(home)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, cuts = sent.value
        for b in batches:
            doc, sentence, packs, bound = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(3).to_numpy()
            x = unit(unpacked(b.column(2), dim))
            who, where = cells.asked(x, bound) if again else (np.arange(len(x)), cells.home(x))
            n = np.array([cuts.get(int(c), 1) for c in where], np.int64)
            if len(who):
                yield part(np.repeat(who, n), np.repeat(where, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), True, doc, sentence, packs, bound)

    def search(t: pa.Table) -> pa.Table:
        t = t.group_by(["query", "doc_id", "sentence_id"]).aggregate([("vector", "min"), ("bound", "min")])  # repeated keys count once
        is_query = t["query"].to_numpy()
        doc, sentence = t["doc_id"].to_numpy(), t["sentence_id"].to_numpy()
        raw = unpacked(t["vector_min"], dim)
        q, r = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        if not len(q) or not len(r):
            i = j = np.empty(0, np.int64)
            cos = np.empty(0)
        else:
            at = {(a, b): k_ for k_, (a, b) in enumerate(zip(doc[r].tolist(), sentence[r].tolist(), strict=True))}
            own = np.array([at.get(p, -1) for p in zip(doc[q].tolist(), sentence[q].tolist(), strict=True)], np.int64)
            w = Windows(unit(raw[r]))
            if again:
                rank = np.argsort(np.lexsort((sentence[r], doc[r])))
                i, j, cos = within_radius(w, raw[r], raw[q], rank, own, k, t["bound_min"].to_numpy()[q])
            else:
                i, j, cos = rehashed_top(w, raw[r], raw[q], own, k)
            i, j = q[i], r[j]
        return pa.table({"doc_id": doc[i], "sentence_id": sentence[i], "near_doc_id": doc[j], "near_sentence_id": sentence[j], "cosine": cos})

    schema = "cell int, piece int, query boolean, doc_id long, sentence_id long, bound double, vector binary"
    tasks = sum(cuts.values()) + 1
    routed = rows.mapInArrow(store, schema).union(asked.mapInArrow(ask, schema)).repartition(2 * tasks, "cell", "piece")
    return routed.groupBy("cell", "piece").applyInArrow(search, "doc_id long, sentence_id long, near_doc_id long, near_sentence_id long, cosine double")


def nearest_of_queries(df: DataFrame, every: int = 100, dim: int = 96, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(doc_id, sentence_id, near_doc_id, near_sentence_id, cosine, rank) for keys whose doc_id is divisible by ``every``.

    Every vector is stored in the cell of its nearest pivot (or the rest cell).
    A query is asked in its home cell by virtual rehashing; the k-th best there
    is a bound, and a second pass asks it in all other cells that can hold a
    vector within that bound, by the triangle inequality.  Ties go to the smaller key.
    Copies of the query's own vector under other keys are neighbours.  NULL,
    short and all-zero vectors neither ask nor answer.
    """
    rows = source(df)
    sample, total = sampled(rows, dim)
    cells = Cells(unit(sample))
    cuts = {c: max(1, int(np.ceil(s * total / block))) for c, s in cells.share.items()}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, raw = matrix(b.column(2), dim)
            yield batch(doc_id=b.column(0).to_numpy()[at], sentence_id=b.column(1).to_numpy()[at], vector=pa.array(packed(raw), pa.binary()))

    asked = rows.filter(F.col("doc_id") % every == 0).mapInArrow(pack, "doc_id long, sentence_id long, vector binary")
    asked = checkpointed(asked.groupBy("doc_id", "sentence_id").agg(F.min("vector").alias("vector")))
    w = Window.partitionBy("doc_id", "sentence_id").orderBy(F.desc("cosine"), "near_doc_id", "near_sentence_id")
    ranked = lambda t: t.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    columns = ["doc_id", "sentence_id", "vector", "bound"]
    near = checkpointed(ranked(_answers(rows, asked.withColumn("bound", F.lit(-1.0)).select(columns), cells, cuts, dim, k, again=False)))
    bound = near.filter(F.col("rank") == k).select("doc_id", "sentence_id", F.col("cosine").alias("bound"))
    # with fewer than k at home anything may be a neighbour
    bounded = asked.join(bound, ["doc_id", "sentence_id"], "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0))).select(columns)
    more = _answers(rows, bounded, cells, cuts, dim, k, again=True)
    return ranked(near.drop("rank").union(more))
