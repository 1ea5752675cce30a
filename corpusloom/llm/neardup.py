"""Near copies among texts: trees over count vectors bound the overlap, survivors are compared in full.

The word pairs of a text are hashed into groups; the number of pairs in each
group is a point.  The overlap of two texts is at most the sum, over the
groups, of the smaller count.  Points that share one of their rarest pairs lie
in one tree; a node keeps the largest counts below it, so the same sum bounds
the overlap with everything in the node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import batch, ragged_binaries
from corpusloom.llm.components import components
from corpusloom.llm.overlap import rare_first
from corpusloom.llm.sketch import pair_frequencies, slots
from corpusloom.llm.textform import PAIR_BITS, distinct_pairs, mix
from corpusloom.plans.stages import checkpointed

LIKENESS = 0.6
LEAF = 8  # points of a leaf
HOT = 20_000  # occurrences of a rarest pair beyond which its points are split into blocks
POSTINGS = 2_000_000  # points of one shard, about
FULL = 3  # counts are kept up to this; what is beyond is added up per text


def short(values: np.ndarray) -> np.ndarray:
    """48-bit values as six bytes each."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].reshape(-1)


def long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def pair_sets(texts: DataFrame) -> DataFrame:
    """(tab, key, name, n, pairs) from (tab, key, texts): distinct word pairs of all texts of a key.

    Keys without a pair are left out.  ``name`` is the 128-bit digest of the set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            offsets = np.asarray(lists.offsets)
            owner = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            pairs, who = distinct_pairs(lists.values[offsets[0] : offsets[-1]].to_pylist(), owner)
            n = np.bincount(who, minlength=b.num_rows)
            some = np.flatnonzero(n)
            flat = short(pairs)
            data = ragged_binaries(flat, n[some] * 6)
            name = [xxhash.xxh3_128_digest(x.as_buffer()) for x in data]
            yield batch(tab=b.column(0).to_numpy()[some], key=b.column(1).to_numpy()[some], name=pa.array(name, pa.binary()), n=n[some], pairs=data)

    return texts.mapInArrow(run, "tab int, key long, name binary, n long, pairs binary")


def groups_of(n: np.ndarray) -> np.ndarray:
    """Groups that a text of n pairs is counted in: the power of two above n, 16 at least."""
    return 1 << np.maximum(np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 1, 4)


def points(pairs: np.ndarray, owner: np.ndarray, n: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Packed count vectors (two bits a group), and what each text has beyond full groups."""
    g = groups_of(n)
    start = np.concatenate([[0], np.cumsum(g)])
    cell = start[owner] + (pairs & (g[owner] - 1).astype(np.uint64)).astype(np.int64)
    count = np.minimum(np.bincount(cell, minlength=start[-1]), FULL).astype(np.uint8)
    kept = np.add.reduceat(count, start[:-1], dtype=np.int64) if len(g) else np.empty(0, np.int64)
    four = count.reshape(-1, 4)
    data = (four[:, 0] | (four[:, 1] << 2) | (four[:, 2] << 4) | (four[:, 3] << 6)).tobytes()
    return [data[a // 4 : b // 4] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)], n - kept


class Points:
    """Count vectors of some texts, by number of groups."""

    def __init__(self, packed: list[bytes], beyond: np.ndarray, n: np.ndarray):
        self.n, self.beyond = n, beyond
        self.groups = np.fromiter((len(p) * 4 for p in packed), np.int64, len(packed))
        self.row = np.zeros(len(packed), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for g in np.unique(self.groups).tolist():
            at = np.flatnonzero(self.groups == g)
            self.row[at] = np.arange(len(at))
            b = np.frombuffer(b"".join(packed[k] for k in at), np.uint8).reshape(len(at), -1, 1)
            self.of[g] = ((b >> np.array([0, 2, 4, 6], np.uint8)) & FULL).reshape(len(at), g)

    def vectors(self, at: np.ndarray, groups: int) -> np.ndarray:
        """Vectors of texts counted in ``groups``, or in twice as many and then folded."""
        out = np.empty((len(at), groups), np.uint8)
        same = self.groups[at] == groups
        if same.any():
            out[same] = self.of[groups][self.row[at[same]]]
        if not same.all():
            v = self.of[2 * groups][self.row[at[~same]]]
            out[~same] = v[:, :groups] + v[:, groups:]
        return out

    def bounded(self, q: np.ndarray, x: np.ndarray, need: np.ndarray, step: int = 20_000) -> np.ndarray:
        """Which pairs of texts can overlap in ``need`` pairs; x is counted in as many groups as q or half as many."""
        good = np.zeros(len(q), bool)
        for g in np.unique(self.groups[x]).tolist() if len(x) else ():
            rows = np.flatnonzero(self.groups[x] == g)
            for k in range(0, len(rows), step):
                r = rows[k : k + step]
                both = np.minimum(self.vectors(q[r], g), self.of[g][self.row[x[r]]]).sum(1, dtype=np.int64)
                a, b = self.beyond[q[r]], self.beyond[x[r]]
                good[r] = both + np.where(self.groups[q[r]] == g, np.minimum(a, b), a + b) >= need[r]
        return good


def required(a: np.ndarray, b: np.ndarray, likeness: float) -> np.ndarray:
    """Pairs in both that texts of a and b pairs need."""
    return np.ceil(likeness / (1 + likeness) * (a + b) - 1e-9).astype(np.int64)


def tree_search(p: Points, tree: np.ndarray, text: np.ndarray, probe_only: np.ndarray, side: np.ndarray, rank: np.ndarray, likeness: float, step: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, found) pairs of texts within each tree whose bound suffices.

    Entries are sorted by tree, then size.  ``probe_only`` entries ask but
    aren't stored; entries of one ``side`` (1 or 2) aren't compared with their own side.
    Every text asks for texts that come before it in (size, rank).
    """
    stored = np.flatnonzero(~probe_only)
    if not len(stored):
        return
    s_tree, s_text = tree[stored], text[stored]
    s_size = p.n[s_text]
    # leaves: up to LEAF stored entries of one tree and one number of groups
    new = np.concatenate([[True], (s_tree[1:] != s_tree[:-1]) | (p.groups[s_text[1:]] != p.groups[s_text[:-1]])])
    run = np.flatnonzero(new)
    within = np.arange(len(stored)) - np.repeat(run, np.diff(np.append(run, len(stored))))
    first = np.flatnonzero(within % LEAF == 0)
    last = np.append(first[1:], len(stored))
    leaf_tree, leaf_low, leaf_high = s_tree[first], s_size[first], s_size[last - 1]
    leaf_groups = p.groups[s_text[first]]
    top: dict[int, np.ndarray] = {}
    leaf_row = np.zeros(len(first), np.int64)
    spare = np.zeros(len(first), np.int64)
    for g in np.unique(leaf_groups).tolist():
        mine = np.flatnonzero(leaf_groups == g)
        leaf_row[mine] = np.arange(len(mine))
        at = np.flatnonzero(p.groups[s_text] == g)
        starts = np.searchsorted(at, first[mine])
        best = np.zeros((len(mine), g), np.uint8)
        for k in range(0, len(mine), 4096):
            a, b = starts[k], starts[k + 4096] if k + 4096 < len(mine) else len(at)
            best[k : k + 4096] = np.maximum.reduceat(p.of[g][p.row[s_text[at[a:b]]]], starts[k : k + 4096] - a, 0)
        top[g] = best
        spare[mine] = np.maximum.reduceat(p.beyond[s_text[at]], starts)
    # the leaves of a query's tree that hold sizes between likeness * size and size
    key = (leaf_tree.astype(np.uint64) << np.uint64(24))
    q_tree, q_size = tree.astype(np.uint64) << np.uint64(24), p.n[text]
    lo = np.searchsorted(key | np.minimum(leaf_high, 0xFFFFFF).astype(np.uint64), q_tree | np.minimum(np.ceil(likeness * q_size - 1e-9), 0xFFFFFF).astype(np.uint64), "left")
    hi = np.searchsorted(key | np.minimum(leaf_low, 0xFFFFFF).astype(np.uint64), q_tree | np.minimum(q_size, 0xFFFFFF).astype(np.uint64), "right")
    n_leaves = np.maximum(hi - lo, 0)
    load = np.concatenate([[0], np.cumsum(n_leaves * LEAF)])
    begin = 0
    while begin < len(text):
        end = max(begin + 1, int(np.searchsorted(load, load[begin] + step, "right")) - 1)
        q = np.repeat(np.arange(begin, end), n_leaves[begin:end])
        leaf = np.repeat(lo[begin:end], n_leaves[begin:end]) + np.arange(len(q)) - np.repeat(np.cumsum(n_leaves[begin:end]) - n_leaves[begin:end], n_leaves[begin:end])
        begin = end
        # a node of one entry or two is no shorter way
        inner = np.flatnonzero(last[leaf] - first[leaf] > 2)
        if len(inner):
            fine = np.ones(len(q), bool)
            for g in np.unique(leaf_groups[leaf[inner]]).tolist():
                r = inner[leaf_groups[leaf[inner]] == g]
                for k in range(0, len(r), 20_000):
                    rr = r[k : k + 20_000]
                    at = text[q[rr]]
                    both = np.minimum(p.vectors(at, g), top[g][leaf_row[leaf[rr]]]).sum(1, dtype=np.int64)
                    least = np.maximum(leaf_low[leaf[rr]], np.ceil(likeness * p.n[at] - 1e-9).astype(np.int64))
                    fine[rr] = both + p.beyond[at] + spare[leaf[rr]] >= required(p.n[at], least, likeness)
            q, leaf = q[fine], leaf[fine]
        count = last[leaf] - first[leaf]
        entry = np.repeat(first[leaf], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        q = np.repeat(q, count)
        a, b = text[q], s_text[entry]
        good = (p.n[b] >= likeness * p.n[a] - 1e-9) & ((p.n[b] < p.n[a]) | ((p.n[b] == p.n[a]) & (rank[b] < rank[a])))
        good &= (side[q] == 0) | (side[q] != side[stored[entry]])
        a, b = a[good], b[good]
        good = p.bounded(a, b, required(p.n[a], p.n[b], likeness))
        if good.any():
            yield a[good], b[good]


def candidate_pairs(sets: DataFrame, frequency: np.ndarray, likeness: float = LIKENESS, hot: int = HOT, postings: int = POSTINGS) -> DataFrame:
    """(tab, key_a, key_b), distinct: pairs of texts that the bounds leave.

    Two texts of that likeness share a pair among the rarest ones of both: of
    the larger text as many as a likeness of the sizes alone leaves, of the
    smaller one, which is stored, fewer still.  Each of these pairs names a
    tree.  Trees are dealt to shards, and a text goes once to each shard that
    holds one of its trees.  The points of a very common pair are split into
    blocks, and every two blocks are a tree of their own.
    """
    spark = sets.sparkSession
    total = sets.agg(F.sum(F.col("n") * (1 - likeness) + 1)).first()[0] or 0
    shards = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // postings + 1))
    sent = spark.sparkContext.broadcast(np.minimum(frequency, 2**31 - 1).astype(np.int32))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                tab, key, n = (part.column(i).to_numpy() for i in (0, 1, 2))
                data = part.column(3)
                flat = long(b"".join(x.as_py() for x in data))
                owner = np.repeat(np.arange(len(n)), n)
                packs, beyond = points(flat, owner, n)
                pairs, owner, at = rare_first(flat, owner, len(n), often)
                size = n[owner]
                probe = at < size - np.ceil(likeness * size - 1e-9) + 1
                pairs, owner, at, size = pairs[probe], owner[probe], at[probe], size[probe]
                only = at >= size - np.ceil(2 * likeness / (1 + likeness) * size - 1e-9) + 1
                blocks = np.maximum(1, -(-often[slots(pairs)] // hot)).astype(np.int64)
                mine = (mix(key.view(np.uint64)) >> np.uint64(9)).astype(np.int64)[owner] % blocks
                copy = np.repeat(np.arange(len(pairs)), blocks)
                other = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                low, high = np.minimum(mine[copy], other), np.maximum(mine[copy], other)
                side = np.where(low == high, 0, np.where(mine[copy] == low, 1, 2))
                tree = mix((pairs[copy] << np.uint64(8)) ^ mix(((low << 20) | high).astype(np.uint64)) ^ tab[owner[copy]].astype(np.uint64)) >> np.uint64(64 - 40)
                shard = (mix(tree) % np.uint64(shards)).astype(np.int64)
                # 40 bits of the tree, then what the entry is
                code = (tree << np.uint64(3)) | (only[copy].astype(np.uint64) << np.uint64(2)) | side.astype(np.uint64)
                order = np.lexsort((shard, owner[copy]))
                code, who, shard = code[order], owner[copy][order], shard[order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(who) != 0) | (np.diff(shard) != 0)])) if len(who) else np.empty(0, np.int64)
                length = np.diff(np.append(new, len(who)))
                t = who[new]
                yield batch(
                    shard=pa.array(shard[new], pa.int32()), tab=tab[t], key=key[t], n=n[t], beyond=beyond[t],
                    vector=pa.array([packs[i] for i in t], pa.binary()), trees=ragged_binaries(short(code), length * 6),
                )

    def search(t: pa.Table) -> pa.Table:
        tab, key = t["tab"].to_numpy(), t["key"].to_numpy()
        p = Points(t["vector"].to_pylist(), t["beyond"].to_numpy(), t["n"].to_numpy())
        lists = t["trees"].to_pylist()
        code = long(b"".join(lists))
        text = np.repeat(np.arange(len(key)), [len(x) // 6 for x in lists])
        tree = (code >> np.uint64(3)).astype(np.int64)
        order = np.lexsort((p.n[text], tree))
        tree, text, code = tree[order], text[order], code[order]
        # trees of one entry hold no pair
        lone = np.concatenate([[True], tree[1:] != tree[:-1]]) & np.concatenate([tree[1:] != tree[:-1], [True]]) if len(tree) else np.empty(0, bool)
        tree, text, code = tree[~lone], text[~lone], code[~lone]
        rank = np.argsort(np.argsort(key, kind="stable"), kind="stable")
        seen: list[np.ndarray] = []
        for a, b in tree_search(p, tree, text, (code & np.uint64(4)) > 0, (code & np.uint64(3)).astype(np.int64), rank, likeness):
            seen.append(np.unique((a << 32) | b))
        both = np.unique(np.concatenate(seen)) if seen else np.empty(0, np.int64)
        a, b = both >> 32, both & 0xFFFFFFFF
        good = (tab[a] == tab[b]) & (key[a] != key[b])
        a, b = a[good], b[good]
        return pa.table({"tab": tab[a], "key_a": np.minimum(key[a], key[b]), "key_b": np.maximum(key[a], key[b])})

    dealt = sets.select("tab", "key", "n", "pairs").mapInArrow(deal, "shard int, tab int, key long, n long, beyond long, vector binary, trees binary")
    return dealt.groupBy("shard").applyInArrow(search, "tab int, key_a long, key_b long").distinct()


def verified(candidates: DataFrame, sets: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """(tab, key_a, key_b, likeness) of the candidates that are like enough, by their full sets."""
    a = sets.select("tab", F.col("key").alias("key_a"), F.col("pairs").alias("pairs_a"))
    b = sets.select("tab", F.col("key").alias("key_b"), F.col("pairs").alias("pairs_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            t = pa.table(x)
            like = np.zeros(t.num_rows)
            for k, (p, q) in enumerate(zip(t["pairs_a"], t["pairs_b"], strict=True)):
                p, q = long(p.as_py()), long(q.as_py())
                both = len(np.intersect1d(p, q, assume_unique=True))
                like[k] = both / (len(p) + len(q) - both)
            good = np.flatnonzero(like >= likeness - 1e-9)
            t = t.take(pa.array(good))
            yield batch(tab=t["tab"].combine_chunks(), key_a=t["key_a"].combine_chunks(), key_b=t["key_b"].combine_chunks(), likeness=like[good])

    return candidates.join(a, ["tab", "key_a"]).join(b, ["tab", "key_b"]).mapInArrow(run, "tab int, key_a long, key_b long, likeness double")


def similar_texts(texts: DataFrame, likeness: float = LIKENESS, plain: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of class representatives (tab, key_a, key_b, likeness), and classes (tab, key, rep).

    ``texts`` has (tab, key, texts).  Keys with the same set of word pairs are
    one class, whose smallest key stands for it; no pair of at least
    ``likeness`` between classes is lost.  NULL and blank texts add nothing, and a key
    without any word pair is in no class.  ``plain`` may give the same texts as a
    single column that needn't be grouped; pairs are counted there.
    """
    frequency = pair_frequencies(texts.select(F.explode("texts").alias("text")) if plain is None else plain)
    sets = checkpointed(pair_sets(texts))
    rep = sets.groupBy("tab", "name").agg(F.min("key").alias("rep"))
    classes = checkpointed(sets.select("tab", "key", "name").join(rep, ["tab", "name"]).select("tab", "key", "rep"))
    only = sets.join(classes.filter("key <> rep").select("tab", "key"), ["tab", "key"], "left_anti")
    candidates = checkpointed(candidate_pairs(only, frequency, likeness))
    ends = candidates.select("tab", F.col("key_a").alias("key")).union(candidates.select("tab", F.col("key_b").alias("key"))).distinct()
    return checkpointed(verified(candidates, sets.join(ends, ["tab", "key"], "left_semi"), likeness)), classes


def near_copy_pairs(texts: DataFrame, likeness: float = LIKENESS, plain: DataFrame | None = None) -> DataFrame:
    """(tab, key_a, key_b), smaller key first: all pairs of keys, copies included."""
    pairs, classes = similar_texts(texts, likeness, plain)
    a = classes.select("tab", F.col("rep").alias("key_a"), F.col("key").alias("a"))
    b = classes.select("tab", F.col("rep").alias("key_b"), F.col("key").alias("b"))
    between = pairs.join(a, ["tab", "key_a"]).join(b, ["tab", "key_b"]).select("tab", "a", "b")
    copies = a.join(b.withColumnRenamed("key_b", "key_a"), ["tab", "key_a"]).filter("a < b").select("tab", "a", "b")
    return between.union(copies).select("tab", F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))


def near_copy_groups(texts: DataFrame, likeness: float = LIKENESS, plain: DataFrame | None = None) -> DataFrame:
    """(tab, key, class_key, group_key, n_links), one row per key with a word pair.

    ``class_key`` is the smallest key with the same set, ``group_key`` the
    smallest class of the group of near copies, directly or over others;
    ``n_links`` counts the classes that this one is like.  Links between
    different texts are all kept; copies aren't expanded into pairs.
    """
    pairs, classes = similar_texts(texts, likeness, plain)
    out = None
    for tab in [r["tab"] for r in classes.select("tab").distinct().collect()]:  # as many as tables
        of = components(pairs.filter(F.col("tab") == tab).select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))
        part = classes.filter(F.col("tab") == tab).join(of.withColumnsRenamed({"node": "rep", "component": "group"}), "rep", "left")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = classes.withColumn("group", F.col("rep")).limit(0)
    links = pairs.select("tab", F.col("key_a").alias("rep")).union(pairs.select("tab", F.col("key_b").alias("rep"))).groupBy("tab", "rep").agg(F.count("*").alias("n_links"))
    return out.join(links, ["tab", "rep"], "left").select("tab", "key", F.col("rep").alias("class_key"), F.coalesce("group", "rep").alias("group_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
