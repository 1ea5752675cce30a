"""Vector search with a stated query set: exact in blocks, and over an index of cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES = 4096  # query vectors that the workers are sent at once
SAMPLE = 16_384  # vectors that the cells of an index are fitted to, at most
CELLS = 1024  # cells of an index, at most
PIECE = 32_768  # vectors of one piece of a large cell


def norms(df: DataFrame, vector: str, name: str = "norm") -> DataFrame:
    """Adds the Euclidean norm in double precision; NULL vectors have NULL, empty ones 0."""
    square = F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(name, F.sqrt(square))


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the vectors of ``dim`` finite components that aren't all zero."""
    lists = column.to_pylist()
    at = np.array([i for i, x in enumerate(lists) if x is not None and len(x) == dim and None not in x], np.int64)
    x = np.array([lists[i] for i in at], np.float64).reshape(-1, dim)
    n = np.sqrt((x * x).sum(1))
    good = np.isfinite(n) & (n > 0)
    return at[good], x[good] / n[good, None]


def _searched(df: DataFrame, queries: DataFrame, key: str, vector: str, dim: int, scan) -> DataFrame:
    """Union over blocks of queries of ``scan(keys, vectors, batches)`` over all rows."""
    spark = df.sparkSession
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("key", T.LongType()), T.StructField("similarity", T.DoubleType())])
    columns = [F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")]
    rows = df.select(*columns).filter("key is not null and v is not null")
    found, block = spark.createDataFrame([], schema), []

    def flush(block: list, found: DataFrame) -> DataFrame:
        at, x = usable(pa.array([r["v"] for r in block], pa.list_(pa.float64())), dim)
        if not len(at):
            return found
        sent = spark.sparkContext.broadcast((np.array([block[i]["key"] for i in at], np.int64), x))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ((b.column(0).to_numpy(), *usable(b.column(1), dim)) for b in batches)
            for q, k, s in scan(*sent.value, ((n[at], x) for n, at, x in names)):
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(k), pa.array(s)], names=["query", "key", "similarity"])

        return found.union(rows.mapInArrow(run, schema))

    for r in queries.select(*columns).filter("key is not null and v is not null").toLocalIterator():
        block.append(r)
        if len(block) == QUERIES:
            found, block = flush(block, found), []
    return flush(block, found) if block else found


def top_k(df: DataFrame, queries: DataFrame, key: str, vector: str, dim: int, k: int) -> DataFrame:
    """(query, key, similarity, rank): the k most similar rows of each query by cosine; a row isn't compared with its own key.

    Queries are read in blocks of a bounded size and sent to all partitions;
    every partition keeps its k best per query, so the shuffle holds k rows per query and
    partition.  Ties go to the smaller key.  Rows whose vector is NULL, of another length, all zero or not finite are left out.
    """

    def scan(keys, q, parts):
        best_s = np.full((len(q), k), -np.inf)
        best_k = np.full((len(q), k), np.iinfo(np.int64).max)
        for names, x in parts:
            for i in range(0, len(x), 2048):
                s = np.round(q @ x[i : i + 2048].T, 9)
                n = np.broadcast_to(names[i : i + 2048], s.shape)
                s = np.where(n == keys[:, None], -np.inf, s)
                both_s, both_k = np.concatenate([best_s, s], 1), np.concatenate([best_k, n], 1)
                order = np.lexsort((both_k, -both_s), axis=1)[:, :k]
                best_s, best_k = np.take_along_axis(both_s, order, 1), np.take_along_axis(both_k, order, 1)
        good = np.isfinite(best_s)
        yield np.repeat(keys, good.sum(1)), best_k[good], best_s[good]

    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    return _searched(df, queries, key, vector, dim, scan).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def within(df: DataFrame, queries: DataFrame, key: str, vector: str, dim: int, floor: float) -> DataFrame:
    """(query, key, similarity): all rows at least ``floor`` similar to a query, but for the query's own key."""

    def scan(keys, q, parts):
        for names, x in parts:
            for i in range(0, len(x), 2048):
                s = np.round(q @ x[i : i + 2048].T, 9)
                a, b = np.nonzero(s >= floor)
                other = keys[a] != names[i : i + 2048][b]
                yield keys[a][other], names[i : i + 2048][b][other], s[a, b][other]

    return _searched(df, queries, key, vector, dim, scan)


def fitted_cells(df: DataFrame, key: str, vector: str, dim: int, rounds: int = 6) -> np.ndarray:
    """Unit centres of about as many cells as the root of the rows, by spherical k-means on a bounded sample picked by a hash of the key."""
    total = df.count()
    share = min(1.0, SAMPLE / max(total, 1))
    picked = df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(np.ceil(share * (1 << 30)))).orderBy(F.xxhash64(key)).limit(SAMPLE)
    _, x = usable(picked.select(F.col(vector).cast("array<double>").alias("v")).toArrow()["v"].combine_chunks(), dim)
    centres = x[: max(1, min(CELLS, int(np.sqrt(total)), len(x)))]
    for _ in range(rounds if len(x) else 0):
        home = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        n = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(n > 0, sums / np.where(n > 0, n, 1), centres)
    return centres


def indexed(df: DataFrame, key: str, vector: str, dim: int, centres: np.ndarray) -> DataFrame:
    """(cell, key, v): every usable vector, of length 1, in the cell of its nearest centre; written with ``partitionBy("cell")`` it is the index."""
    sent = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = usable(b.column(1), dim)
            home = (x @ sent.value.T).argmax(1) if len(sent.value) else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), b.column(0).take(pa.array(at)), pa.array(list(x), pa.list_(pa.float64()))], names=["cell", "key", "v"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).filter("key is not null and v is not null")
    return rows.mapInArrow(run, "cell int, key long, v array<double>")


def index_top_k(index: DataFrame, centres: np.ndarray, queries: DataFrame, key: str, vector: str, dim: int, k: int, probes: int) -> DataFrame:
    """(query, key, similarity, rank): the k most similar rows in the ``probes`` cells nearest to each query; approximate unless all cells are asked.

    Large cells are cut into pieces by a hash of the key, and each piece is one
    group.  Ties go to the smaller key; a row isn't compared with its own key.
    """
    sent = index.sparkSession.sparkContext.broadcast(centres)
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))  # one row per cell

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = usable(b.column(1), dim)
            near = np.argsort(-(x @ sent.value.T), 1, kind="stable")[:, :probes]
            n = near.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), b.column(0).take(pa.array(np.repeat(at, n))), pa.array(list(np.repeat(x, n, 0)), pa.list_(pa.float64()))], names=["cell", "key", "v"])

    asked = queries.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).filter("key is not null and v is not null").mapInArrow(probe, "cell int, key long, v array<double>")
    asked = asked.join(F.broadcast(sizes), "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    stored = index.join(F.broadcast(sizes), "cell").withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int")).drop("pieces")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        q, x = (np.array(t["v"].to_pylist(), np.float64).reshape(-1, dim) for t in (a, b))
        qk, xk = a["key"].to_numpy(), b["key"].to_numpy()
        out = []
        for i in range(0, len(q) if len(x) else 0, 256):
            s = np.round(q[i : i + 256] @ x.T, 9)
            s[qk[i : i + 256, None] == xk[None]] = -np.inf
            order = np.lexsort((np.broadcast_to(xk, s.shape), -s), axis=1)[:, :k]
            best = np.take_along_axis(s, order, 1)
            r, c = np.nonzero(np.isfinite(best))
            out.append((qk[i + r], xk[order[r, c]], best[r, c]))
        one, two, three = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"query": one, "key": two, "similarity": three})

    found = asked.groupBy("cell", "piece").cogroup(stored.groupBy("cell", "piece")).applyInArrow(search, "query long, key long, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    return found.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
