"""Samples: stratified splits, weighted draws, quotas with a floor and a ceiling per label."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(*columns: str, seed: str = "42") -> Column:
    """Hexadecimal digest that orders rows at random, the same on every run."""
    return F.md5(F.concat_ws("|", *columns, F.lit(seed)))


def uniform(*columns: str, seed: str = "42") -> Column:
    """Number between 0 and 1 (neither included) from the first 13 hexadecimal digits of the draw key."""
    return (F.conv(F.substring(draw_key(*columns, seed=seed), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def validation_sizes(pos: Column, neg: Column) -> tuple[Column, Column]:
    """Validation rows of either class: a tenth of each, a fifth of all together as far as there are rows."""
    up = lambda share, n: F.ceil(F.round(share * n, 9))
    val_pos = F.least(F.greatest(up(0.1, pos), up(0.2, pos)), pos)
    val_neg = F.least(F.greatest(up(0.1, neg), up(0.2, pos + neg) - val_pos), neg)
    return val_pos, val_neg


def split_by_class(df: DataFrame, groups: list[str], label: str, key: str) -> DataFrame:
    """Adds part (train or validation): per group and class the first rows of a fixed random order are validation.

    Rows with a NULL label or group are left out.  Repeated keys are rows of their own.
    """
    rows = df.filter(F.col(label).isNotNull())
    sizes = rows.groupBy(*groups).agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    vp, vn = validation_sizes(F.col("_pos"), F.col("_neg"))
    limits = sizes.select(*groups, F.explode(F.array(F.struct(F.lit(1).alias("_l"), vp.alias("_n")), F.struct(F.lit(0).alias("_l"), vn.alias("_n")))).alias("_x")).select(*groups, "_x.*")
    w = Window.partitionBy(*groups, label).orderBy(draw_key(key), key)
    placed = rows.withColumn("_r", F.row_number().over(w)).join(limits, groups)
    return placed.filter(F.col(label) == F.col("_l")).withColumn("part", F.when(F.col("_r") <= F.col("_n"), "validation").otherwise("train")).drop("_r", "_l", "_n")


def row_weights(df: DataFrame, codes: list[str]) -> DataFrame:
    """Adds weight: sum over positive labels of 1/sqrt(frequency); rows without one get the smallest positive weight.

    Frequencies come from one aggregate.  A table without positives gives weight 1.
    """
    f = df.agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in codes]).first()
    w = sum([F.when(F.col(c) == 1, 1.0 / math.sqrt(max(f[c] or 0, 1))).otherwise(0.0) for c in codes], F.lit(0.0))
    weighted = df.withColumn("weight", w)
    low = weighted.filter("weight > 0").agg(F.min("weight").alias("m")).first()["m"] or 1.0
    return weighted.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(low)))


def weighted_sample(df: DataFrame, n: int, weight: str, *keys: str) -> DataFrame:
    """n rows without replacement, each with a chance by its weight (largest u^(1/w)); all rows if there are fewer."""
    return df.withColumn("_k", F.log(uniform(*keys)) / F.col(weight)).orderBy(F.desc("_k"), *keys).limit(n).drop("_k")


def first_per_group(df: DataFrame, group: str, n: int, *keys: str) -> DataFrame:
    """n rows per group in a fixed random order; the window keeps only n rows per partition before the shuffle."""
    w = Window.partitionBy(group).orderBy(draw_key(*keys), *keys)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def language_quotas(counts: dict[str, int], total: int) -> dict[str, int]:
    """Equal quotas; what one language lacks goes to the others that have more."""
    quota = {k: 0 for k in counts}
    left, open_ = min(total, sum(counts.values())), sorted(counts)
    while left > 0 and open_:
        share, extra = divmod(left, len(open_))
        for i, k in enumerate(list(open_)):
            take = min(share + (i < extra), counts[k] - quota[k])
            quota[k] += take
            left -= take
        open_ = [k for k in open_ if quota[k] < counts[k]]
    return quota


def upscaled(total: int, labels: int, floor: int, share: float = 0.5) -> int:
    """A sample too small to give ``share`` of the labels their floor is made larger."""
    return max(total, math.ceil(floor * labels * share))


def adjusted(labels: np.ndarray, drawn: int, quota: int, floor: int, ceiling: float) -> np.ndarray:
    """Which rows of a 0/1 matrix stay: the first ``drawn`` are the sample, the others its supply, in order of preference.

    Labels below the floor in the drawn rows are topped up one after the other
    (rows added for an earlier one count).  While a label is beyond its share, the last of its rows
    that no label at its floor needs leaves.  Then the surplus over ``quota``
    leaves, last rows first, as far as no label at its floor needs them.
    """
    kept = np.arange(len(labels)) < drawn
    count = labels[kept].sum(0)
    for c in np.flatnonzero(count < floor):
        spare = np.flatnonzero(~kept & (labels[:, c] == 1))
        more = spare[: max(0, floor - int(count[c]))]
        kept[more] = True
        count = labels[kept].sum(0)

    def leave(rows: np.ndarray, enough) -> None:
        for r in rows[::-1]:
            if enough():
                break
            has = labels[r] == 1
            if (count[has] > floor).all():
                kept[r] = False
                count[has] -= 1

    for c in np.flatnonzero(count > ceiling * kept.sum()):
        leave(np.flatnonzero(kept & (labels[:, c] == 1)), lambda c=c: count[c] <= ceiling * kept.sum())
    leave(np.flatnonzero(kept), lambda: kept.sum() <= quota)
    return kept


def constrained_sample(pool: DataFrame, key: list[str], codes: list[str], size: int, floor: int = 40, ceiling: float = 0.35) -> DataFrame:
    """``size`` rows, weighted to rare labels, with at least ``floor`` of each label (as far as there are) and none beyond a share of ``ceiling``.

    A weighted draw, and for each label its ``floor`` first rows by draw key,
    which is all that any adjustment can add: ``size + floor * labels`` rows at
    most reach the driver, whatever the table holds.  Floors go before the ceiling and the size.
    """
    spark = pool.sparkSession
    weighted = row_weights(pool, codes).select(*key, *codes, "weight")
    drawn = weighted_sample(weighted, size, "weight", *key).select(*key, *codes).withColumn("_drawn", F.lit(1))
    long = weighted.select(*key, *codes).unpivot(key, codes, "_code", "_v").filter("_v = 1")
    held = first_per_group(long, "_code", floor, *key).select(*key).distinct()
    supply = weighted.select(*key, *codes).join(held, key, "left_semi").withColumn("_drawn", F.lit(0))
    rows = drawn.union(supply).groupBy(*key, *codes).agg(F.max("_drawn").alias("_drawn")).orderBy(F.desc("_drawn"), draw_key(*key), *key).toArrow()
    labels = np.stack([np.nan_to_num(rows[c].to_numpy().astype(float)) == 1 for c in codes], 1).astype(np.int64) if rows.num_rows else np.zeros((0, len(codes)), np.int64)
    kept = adjusted(labels, int(np.sum(rows["_drawn"].to_numpy())) if rows.num_rows else 0, size, floor, ceiling)
    return spark.createDataFrame(rows.filter(pa.array(kept)).select([*key, *codes]), weighted.select(*key, *codes).schema)


def oversampled(df: DataFrame, label: str, key: str) -> DataFrame:
    """Adds draw: rows of the smaller class come several times, so that the classes are about even.

    Each row comes floor(largest class / its class) times, and once more for as many as are
    missing by the fixed random order's share.  NULL labels are left out.
    """
    rows = df.filter(F.col(label).isNotNull())
    n = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # as many rows as classes
    top = max(n.values(), default=0)
    times = F.lit(1)
    for v, k in n.items():
        whole, rest = divmod(top, k)
        times = F.when(F.col(label) == v, whole + (uniform(key) < rest / k).cast("int")).otherwise(times)
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(1), times)))
