"""Usable vectors, lossless packing, and cells around pivots fitted to a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import batch

SAMPLE, SAMPLE_MOST, SAMPLE_SHARE = 8192, 65_536, 32  # pivots are fitted to about one vector in SAMPLE_SHARE, within these bounds
PIVOTS = 4096  # pivots at most
FAR = 60.0  # degrees from the nearest pivot beyond which a vector belongs to the rest cell
REST = -1


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float32 matrix) of the vectors with ``dim`` finite components that aren't all zero."""
    offsets = np.asarray(column.offsets)
    values = column.values
    right = (np.diff(offsets) == dim) & np.asarray(column.is_valid())
    rows = np.flatnonzero(right)
    if values.null_count:
        values = values.fill_null(float("nan"))
    flat = np.asarray(values, dtype=np.float32)
    x = flat[offsets[rows][:, None] + np.arange(dim)] if len(rows) else np.empty((0, dim), np.float32)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in half precision where that loses nothing, else in single precision."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    exact = (half.astype(np.float32) == x).all(1)
    small, large = half.tobytes(), np.ascontiguousarray(x).tobytes()
    w = x.shape[1] * 2
    return [small[k * w : k * w + w] if e else large[2 * k * w : 2 * k * w + 2 * w] for k, e in enumerate(exact)]


def unpacked(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    parts = column.to_pylist()
    short = np.fromiter((len(p) == 2 * dim for p in parts), bool, len(parts))
    out = np.empty((len(parts), dim), np.float32)
    if short.any():
        out[short] = np.frombuffer(b"".join(p for p, s in zip(parts, short, strict=True) if s), np.float16).reshape(-1, dim)
    if not short.all():
        out[~short] = np.frombuffer(b"".join(p for p, s in zip(parts, short, strict=True) if not s), np.float32).reshape(-1, dim)
    return out


def names(packs: list[bytes]) -> list[bytes]:
    """128-bit name of each packed vector: equal vectors have equal names."""
    return [xxhash.xxh3_128_digest(p) for p in packs]


def dealt(name: list[bytes], ways: int | np.ndarray) -> np.ndarray:
    """A number below ``ways`` for each name."""
    return (np.frombuffer(b"".join(name), np.uint32).reshape(-1, 4)[:, 0] % ways).astype(np.int64)


def source(df: DataFrame, doc: str = "doc_id", sentence: str = "sentence_id", vector: str = "embedding") -> DataFrame:
    return df.select(F.col(doc).cast("long").alias("doc_id"), F.col(sentence).cast("long").alias("sentence_id"), F.col(vector).cast("array<float>").alias("v")).filter("doc_id is not null and sentence_id is not null and v is not null")


def members(rows: DataFrame, dim: int) -> DataFrame:
    """(doc_id, sentence_id, name), one row per key: which vector each key has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = matrix(b.column(2), dim)
            yield batch(doc_id=b.column(0).to_numpy()[at], sentence_id=b.column(1).to_numpy()[at], name=pa.array(names(packed(x)), pa.binary()))

    return rows.mapInArrow(run, "doc_id long, sentence_id long, name binary").groupBy("doc_id", "sentence_id").agg(F.min("name").alias("name"))


def sampled(rows: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """A bounded sample of unit vectors picked by a hash of the key (twice ``SAMPLE_MOST`` at most), and the number of rows."""
    total = rows.count()
    size = min(max(SAMPLE, total // SAMPLE_SHARE), SAMPLE_MOST)
    share = min(1.0, size / max(total, 1))
    picked = rows.filter(F.pmod(F.xxhash64("doc_id", "sentence_id"), F.lit(1 << 40)) < int(np.ceil(share * (1 << 40)))).limit(2 * size)
    t = picked.select("v").toArrow().combine_chunks()
    column = t["v"].chunk(0) if t["v"].num_chunks else pa.array([], pa.list_(pa.float32()))
    _, x = matrix(column, dim)
    return x, total


def fitted_pivots(sample: np.ndarray, near: float = 0.6, merge: float = 0.8, least: int = 3, most: int = PIVOTS) -> np.ndarray:
    """Centres of the sample's dense parts.

    Leaders are picked in order, each vector going to the nearest leader within
    ``near``; the centres of their followers are merged where they are closer
    than ``merge``; centres of fewer than ``least`` vectors are dropped.
    """
    dim = sample.shape[1]
    leaders = np.empty((0, dim), np.float32)
    for first in range(0, len(sample), 512):
        x = sample[first : first + 512]
        left = x[(x @ leaders.T >= near).any(1) == 0] if len(leaders) else x
        new: list[np.ndarray] = []
        while len(left):
            new.append(left[0])
            left = left[left @ left[0] < near]
        if new:
            leaders = np.concatenate([leaders, new])
    if not len(leaders):
        return leaders
    sim = sample @ leaders.T
    home, good = sim.argmax(1), sim.max(1) >= near
    centre = np.zeros_like(leaders)
    np.add.at(centre, home[good], sample[good])
    count = np.bincount(home[good], minlength=len(leaders))
    order = np.argsort(-count, kind="stable")
    kept, direction, weight = np.empty_like(centre), np.empty_like(centre), np.zeros(len(centre), np.int64)
    n = 0
    for k in order:
        c = centre[k] / max(np.linalg.norm(centre[k]), 1e-9)
        close = np.flatnonzero(direction[:n] @ c >= merge)
        at = int(close[0]) if len(close) else n
        kept[at] = kept[at] + centre[k] if len(close) else centre[k]
        direction[at] = kept[at] / np.linalg.norm(kept[at])
        weight[at] += int(count[k])
        n += not len(close)
    weight = weight[:n]
    good = [i for i in np.argsort(-weight, kind="stable") if weight[i] >= least][:most]
    return unit(np.array([kept[i] for i in good])) if good else np.empty((0, dim), np.float32)


class Cells:
    """Cells around pivots: which cells a vector has to be sent to so that all close pairs meet.

    A vector is at home in the cell of its nearest pivot, if it is no farther
    from it than the farthest vector of the sample there (``FAR`` at most); all
    others are at home in the rest cell.  With ``wide`` the bound is ``FAR``
    everywhere.  ``sample`` are unit vectors.
    """

    def __init__(self, sample: np.ndarray, wide: bool = False):
        self.pivots = fitted_pivots(sample)
        n = len(self.pivots)
        self.reach = np.full(n, FAR if wide else 0.0)
        self.share = {REST: 1.0}
        if n:
            home, best, _ = self._nearest(sample)
            placed = best <= FAR
            np.maximum.at(self.reach, home[placed], best[placed])
            count = np.bincount(home[placed], minlength=n)
            self.share = {c: k / len(sample) for c, k in enumerate(count.tolist())} | {REST: 1 - placed.sum() / len(sample)}

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        angle = np.degrees(np.arccos(np.clip(x @ self.pivots.T, -1, 1)))
        return angle.argmin(1), angle.min(1), angle

    def home(self, x: np.ndarray) -> np.ndarray:
        if not len(self.pivots):
            return np.full(len(x), REST)
        home, best, _ = self._nearest(x)
        return np.where(best <= self.reach[home] + 1e-3, home, REST)

    def routes(self, x: np.ndarray, turn: float, both_ways: bool = False) -> list[tuple[int, np.ndarray, bool]]:
        """(cell, rows, at home) such that any two vectors within ``turn`` degrees meet where one of them is at home.

        Two vectors at home near pivots meet in the cell of the one that is
        nearer to its pivot, so by the triangle inequality the other one is at
        most its own angle and the turn away from that pivot.  ``both_ways``: they meet in
        either one's cell.
        """
        if not len(self.pivots):
            return [(REST, np.arange(len(x)), True)]
        home, best, angle = self._nearest(x)
        placed = best <= self.reach[home] + 1e-3
        out = [(REST, np.flatnonzero(~placed), True)]
        if both_ways:  # partners in the rest cell lie beyond the reach of their nearest pivot
            out.append((REST, np.flatnonzero(placed & (best >= self.reach.min() - turn - 1e-3)), False))
        for c in range(len(self.pivots)):
            at_home = placed & (home == c)
            bound = np.minimum(best + turn, self.reach[c]) if both_ways else np.where(placed, np.minimum(best, self.reach[c]), self.reach[c])
            out.append((c, np.flatnonzero(at_home), True))
            out.append((c, np.flatnonzero(~at_home & (angle[:, c] <= bound + turn + 2e-3)), False))
        return out

    def asked(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): the cells, but for its home, that can hold a vector with a cosine of at least ``bound`` to a row."""
        if not len(self.pivots):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        home, best, angle = self._nearest(x)
        placed = best <= self.reach[home] + 1e-3
        turn = np.degrees(np.arccos(np.clip(bound, -1, 1)))
        may = angle <= self.reach[None] + turn[:, None] + 2e-3
        may[np.flatnonzero(placed), home[placed]] = False
        row, cell = np.nonzero(may)
        outer = np.flatnonzero(placed)
        return np.concatenate([row, outer]), np.concatenate([cell, np.full(len(outer), REST)])
