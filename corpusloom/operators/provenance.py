"""Analytics over logs: blocks of activity, record-breaking epochs, trends, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def activity_blocks(df: DataFrame, key: str, ts: str, gap_hours: float = 6.0) -> DataFrame:
    """(key, block, n, first, last, hours): runs of rows without a gap of more than ``gap_hours``.

    A gap of exactly that length doesn't end a block.  NULL times are left out;
    repeated times count each.  Blocks are numbered from 0 per key.
    """
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) > int(gap_hours * 3_600_000_000)
    numbered = df.filter(F.col(ts).isNotNull()).withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("block", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(key, "block").agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return out.withColumn("hours", F.round((F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 3.6e9, 2))


def span(df: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, n, first, last, hours): from the first to the last entry; NULL times are left out."""
    out = df.filter(F.col(ts).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return out.withColumn("hours", F.round((F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 3.6e9, 2))


def densest_blocks(df: DataFrame, key: str, ts: str, gap_hours: float = 6.0) -> DataFrame:
    """Per key the block with most rows; of equal ones the first."""
    w = Window.partitionBy(key).orderBy(F.desc("n"), "block")
    return activity_blocks(df, key, ts, gap_hours).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def record_epochs(df: DataFrame, key: str, epoch: str, score: str, tolerance: float = 1e-6) -> DataFrame:
    """(key, kept, best): epochs whose score beats the best kept so far by more than the tolerance, and the last such score.

    The first epoch with a score is kept.  NULL scores never are.  Logs of one key are one short
    row (epochs of a training run), folded in order by a higher-order function.
    """
    log = df.filter(F.col(score).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("long").alias("e"), F.col(score).cast("double").alias("s")))).alias("log"))
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(float("-inf")).alias("best"))
    step = lambda acc, x: F.when(x["s"] > acc["best"] + tolerance, F.struct(F.concat(acc["kept"], F.array(x["e"])).alias("kept"), x["s"].alias("best"))).otherwise(acc)
    return log.select(key, F.aggregate("log", start, step).alias("a")).select(key, "a.kept", "a.best")


def trend(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Least-squares slope and intercept of y over x, and the mean of y."""
    g = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*(by or []))
    return g.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.avg(y), 6).alias("mean"), F.count("*").alias("n"))


def parent_name(label: str) -> Column:
    """Name of the model that decides on a label's parent: the trailing number and _SUB give way to _Detection."""
    return F.concat(F.regexp_replace(label, r"_?\d*_SUB$", ""), F.lit("_Detection"))


def model_name_parts(df: DataFrame, name: str) -> DataFrame:
    """(name, language, stem, kind, label) from names like <label>[_Detection]_<EN|FR>[.jsonl].model."""
    base = F.regexp_replace(name, r"(\.jsonl)?\.model$", "")
    stem = F.regexp_replace(base, r"_(EN|FR)$", "")
    return df.select(
        name, F.when(base.endswith("_EN"), "EN").when(base.endswith("_FR"), "FR").alias("language"), stem.alias("stem"),
        F.when(stem.endswith("_Detection"), "detection").otherwise("sub").alias("kind"), F.regexp_replace(stem, "_Detection$", "").alias("label"),
    )
