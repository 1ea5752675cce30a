"""Numbering rows within groups without gathering any group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.plans.stages import checkpointed


def ranked(df: DataFrame, key: str, order: list[str], name: str = "rank") -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each value of the integer column ``key``, by ``order``.

    Rows are range-partitioned by key and order, numbered within their
    partition, and shifted by what earlier partitions hold of the same key.  A
    key that holds most rows is spread over many partitions.  The order must be
    total, or ranks of ties may swap.
    """
    sorted_rows = checkpointed(df.repartitionByRange(F.col(key), *map(F.col, order)).sortWithinPartitions(key, *order).withColumn("_part", F.spark_partition_id()))
    schema = T.StructType([*sorted_rows.schema.fields, T.StructField("_at", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            at = np.arange(len(k)) - np.repeat(starts, np.diff(np.append(starts, len(k))))
            if last is not None and k[0] == last:
                at[: starts[1] if len(starts) > 1 else len(k)] += seen
            last, seen = k[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "_at"])

    here = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per key and partition: as many as keys and partitions together, as the rows are in ranges
    before = sorted_rows.groupBy(key, "_part").count().withColumn("_before", F.coalesce(F.sum("count").over(here), F.lit(0))).drop("count")
    return (
        sorted_rows.mapInArrow(number, schema)
        .join(before, [key, "_part"])
        .withColumn(name, F.col("_at") + F.col("_before"))
        .drop("_part", "_at", "_before")
    )
