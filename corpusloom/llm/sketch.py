"""How often each word pair occurs, in a table of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import batch, strings
from corpusloom.llm.textform import PAIR_BITS, hashed_pairs

SLOT_BITS = 18


def slots(pairs: np.ndarray) -> np.ndarray:
    return (pairs >> np.uint64(PAIR_BITS - SLOT_BITS)).astype(np.int64)


def pair_frequencies(texts: DataFrame, ways: int = 8) -> np.ndarray:
    """Occurrences of word pairs over all rows of the one text column, per slot.

    Pairs that share a slot share its count.  The table has ``2**SLOT_BITS``
    entries whatever the input; one per partition is summed in ``ways`` tasks,
    and ``ways`` of them reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            pairs, _ = hashed_pairs(strings(b.column(0)))
            total += np.bincount(slots(pairs), minlength=1 << SLOT_BITS)
        yield batch(way=np.random.default_rng().integers(0, ways, 1), total=pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            for x in b.column(1):
                total += np.frombuffer(x.as_buffer(), np.uint32)
        yield batch(total=pa.array([total.tobytes()], pa.binary()))

    sums = texts.mapInArrow(count, "way long, total binary").repartition(ways, F.col("way")).mapInArrow(add, "total binary")
    return np.sum([np.frombuffer(r["total"], np.int64) for r in sums.collect()], axis=0, dtype=np.int64)
