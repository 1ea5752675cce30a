"""Connected components by hooking and pointer jumping on a contracting edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.stages import checkpointed

TAIL = 200_000  # edges left of a contracting table from which the last rounds run in one task


def numbered(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct ends in rising order, and both columns as numbers of them."""
    ends = pc.unique(pa.chunked_array([*a.chunks, *b.chunks], type=a.type))
    ends = ends.take(pc.sort_indices(ends))
    return ends, pc.index_in(a, ends).to_numpy().astype(np.int64), pc.index_in(b, ends).to_numpy().astype(np.int64)


def connected(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's component: labels spread along edges, and pointers are jumped."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        if (label == before).all():
            return label


def local_forest(i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the edges of a heaviest spanning forest, by Borůvka's rounds on arrays; the nodes, and their labels."""
    ids, ends = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = ends[: len(i)], ends[len(i) :]
    rank = np.empty(len(w), np.int64)
    rank[np.lexsort((j, i, -w))] = np.arange(len(w))  # a strict order of the edges
    label, live, kept = np.arange(len(ids)), np.arange(len(w)), []
    while len(live):
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            break
        la, lb = label[a[live]], label[b[live]]
        best = np.full(len(ids), len(w), np.int64)
        np.minimum.at(best, la, rank[live])
        np.minimum.at(best, lb, rank[live])
        pick = live[(best[la] == rank[live]) | (best[lb] == rank[live])]
        kept.append(pick)
        label = connected(label[a[pick]], label[b[pick]], len(ids))[label]
    return np.concatenate(kept) if kept else np.empty(0, np.int64), ids, label


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches) if batches else None


def jumped(parent: DataFrame) -> DataFrame:
    """Pointer jumping: each node's parent becomes its root.

    ``parent`` has (node, up) without cycles but for ``up = node``; a node that
    is no key is a root.  The depth halves each round, until nothing moves.
    """
    while True:
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = checkpointed(
            parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") != F.col("up")).alias("moved"))
        )
        if parent.filter("moved").limit(1).count() == 0:
            break
    return parent.select("node", "up")


def components(edges: DataFrame, a: str = "a", b: str = "b", tail: int = TAIL) -> DataFrame:
    """(node, component) for every node of the edges; a component's name is its smallest node.

    Each round hooks every node to its smallest neighbour, jumps pointers to the
    roots and replaces the edges by those between roots, so the edge table
    shrinks at least by half in nodes.  Self loops and NULL ends are left out;
    no edges give no rows.  Only partial aggregates and equi-joins move data, so a
    node with very many edges is combined before the shuffle.  Once no more than
    ``tail`` edges are left, the remaining rounds run on arrays in one task.
    """
    edges = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a is not null and b is not null and a < b")
    if edges.limit(tail + 1).count() <= tail:
        return _last_components(edges, roots=True)
    live = checkpointed(edges.distinct())
    labels = None
    while n := live.limit(tail + 1).count():
        if n <= tail:
            first = checkpointed(_last_components(live))
            labels = first if labels is None else checkpointed(_renamed(labels, first))
            break
        # every edge points from its larger end to its smaller one: hooking along it can't make a cycle
        hook = live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        root = jumped(checkpointed(hook))
        first = root.select("node", F.col("up").alias("component"))
        if labels is None:
            labels = first
        else:
            labels = checkpointed(_renamed(labels, first))
        ra = root.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        rb = root.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        ends = live.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        live = checkpointed(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    return labels.union(roots.join(labels, "node", "left_anti"))


def _renamed(labels: DataFrame, first: DataFrame) -> DataFrame:
    """Labels with those components renamed that ``first`` joins to others, and what is only in ``first``."""
    step = first.select(F.col("node").alias("component"), F.col("component").alias("up"))
    moved = labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return moved.union(first.join(labels, "node", "left_anti"))


def _last_components(live: DataFrame, roots: bool = False) -> DataFrame:
    """(node, component) of a table of bounded size, in one task; ``roots``: with the components' own names."""
    kind = live.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _whole(batches)
        if t is not None:
            ends, i, j = numbered(t["a"], t["b"])
            label = connected(i, j, len(ends))
            other = np.flatnonzero((label != np.arange(len(ends))) | roots)
            yield pa.RecordBatch.from_arrays([ends.take(pa.array(other)), ends.take(pa.array(label[other]))], ["node", "component"])

    return live.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def _last_forest(live: DataFrame) -> DataFrame:
    """(a, b, weight) of the forest's edges, and (node, component) of the components in other rows."""
    kind = live.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _whole(batches)
        if t is not None:
            ends, i, j = numbered(t["ca"], t["cb"])
            keep, ids, label = local_forest(i, j, t["weight"].to_numpy())
            tree = t.select(["a", "b", "weight"]).take(pa.array(keep)).combine_chunks()
            none = pa.nulls(len(keep), ends.type)
            columns = [(c.chunk(0) if c.num_chunks else pa.array([], c.type)) for c in tree.columns]
            yield pa.RecordBatch.from_arrays([*columns, none, none], ["a", "b", "weight", "node", "component"])
            none = pa.nulls(len(ids), ends.type)
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(ids), pa.float64()), ends.take(pa.array(ids)), ends.take(pa.array(ids[label]))], ["a", "b", "weight", "node", "component"])

    return live.coalesce(1).mapInArrow(run, f"a {kind}, b {kind}, weight double, node {kind}, component {kind}")


def spanning_forest(edges: DataFrame, tail: int = TAIL) -> tuple[DataFrame, DataFrame]:
    """Borůvka's rounds on (a, b, weight): the heaviest spanning forest and (node, component).

    Each round every component picks its heaviest edge to another one (ties: the
    smallest ends), the picks join the forest, pointers are jumped to the new
    roots, and edges within a component drop out.  Names of components are
    nodes of them, not the smallest ones.  Weights must not be NULL.  Nodes may be of any type with an order.  Once no
    more than ``tail`` edges are left, the remaining rounds run on arrays in one task.
    """
    live = checkpointed(
        edges.filter("a is not null and b is not null and a <> b")
        .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("weight").alias("weight"))
        .select("a", "b", "weight", F.col("a").alias("ca"), F.col("b").alias("cb"))
    )
    tree, labels = None, None
    while n := live.limit(tail + 1).count():
        if n <= tail:
            last = checkpointed(_last_forest(live))
            new = last.filter("node is null").select("a", "b", "weight")
            first = last.filter("node is not null").select("node", "component")
            tree = new if tree is None else tree.union(new)
            labels = first if labels is None else checkpointed(_renamed(labels, first))
            break
        both = live.select("ca", "cb", "a", "b", "weight").union(live.select("cb", "ca", "a", "b", "weight"))
        # ends in one order, so that both components rank an edge alike and no long cycles can arise
        pick = both.groupBy(F.col("ca").alias("node")).agg(F.min(F.struct((-F.col("weight")).alias("w"), "a", "b", F.col("cb").alias("other"))).alias("p"))
        pick = checkpointed(pick.select("node", "p.other", "p.a", "p.b", (-F.col("p.w")).alias("weight")))
        new = pick.select("a", "b", "weight").distinct()
        tree = new if tree is None else tree.union(new)
        back = pick.select(F.col("node").alias("other"), F.col("other").alias("back"))
        # two components that pick each other: the smaller one is the root
        up = pick.join(back, "other", "left").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("other")), F.col("node")).otherwise(F.col("other")).alias("up"))
        root = jumped(checkpointed(up))
        first = root.select("node", F.col("up").alias("component"))
        labels = first if labels is None else checkpointed(_renamed(labels, first))
        ra, rb = root.select(F.col("node").alias("ca"), F.col("up").alias("ra")), root.select(F.col("node").alias("cb"), F.col("up").alias("rb"))
        live = checkpointed(
            live.join(ra, "ca").join(rb, "cb").filter("ra <> rb").select("a", "b", "weight", F.col("ra").alias("ca"), F.col("rb").alias("cb"))
        )
    if labels is None:
        nothing = edges.select("a", "b", "weight").limit(0)
        return nothing, edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return tree, labels
