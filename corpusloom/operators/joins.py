"""Lookups and set algebra on labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOKUP_MOST = 10_000  # rows of a lookup table that is broadcast


def bounded(lookup: DataFrame, most: int = LOOKUP_MOST) -> DataFrame:
    """The lookup marked for broadcasting if it has at most ``most`` rows, else as it is."""
    return F.broadcast(lookup) if lookup.limit(most + 1).count() <= most else lookup


def normalized(names: DataFrame, raw: str, categories: DataFrame, unknown: int = 99, strict: bool = False) -> DataFrame:
    """(raw, number, unmapped): names brought to category numbers.

    Tried in turn: the code, the readable name, the readable name behind
    underscores, the code within a model file name.  What fits nothing gets
    ``unknown``, or with ``strict`` stops the job.  NULL names are unmapped.
    """
    by_code = bounded(categories.select(F.col("code").alias("_k"), F.col("number").alias("_n")))
    by_name = bounded(categories.select(F.col("category").alias("_k"), F.col("number").alias("_n")))
    out = names.select(F.col(raw).alias("raw"))
    tries = [(by_code, F.col("raw")), (by_name, F.col("raw")), (by_name, F.replace("raw", F.lit("_"), F.lit(" "))), (by_code, F.regexp_extract("raw", r"([^/]*?)(_EN|_FR)?(\.jsonl)?\.model$", 1))]
    for k, (lookup, key) in enumerate(tries):
        out = out.withColumn("_key", key).join(lookup.withColumnsRenamed({"_k": "_key", "_n": f"_n{k}"}), "_key", "left").drop("_key")
    found = F.coalesce(*[f"_n{k}" for k in range(len(tries))])
    other = F.raise_error(F.concat(F.lit("no category for "), F.coalesce("raw", F.lit("NULL")))).cast("int") if strict else F.lit(unknown)
    return out.select("raw", F.coalesce(found, other).alias("number"), found.isNull().alias("unmapped"))


def readable(names: DataFrame, raw: str, categories: DataFrame) -> DataFrame:
    """(raw, readable): the category's name of each code, or the name itself where there is none; NULL stays NULL."""
    of = bounded(categories.select(F.col("code").alias("_k"), F.col("category").alias("_c")))
    return names.select(F.col(raw).alias("raw")).join(of, F.col("raw") == F.col("_k"), "left").select("raw", F.coalesce("_c", "raw").alias("readable"))


def with_region(articles: DataFrame, lookup: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``region`` by outlet name without regard to case and outer blanks.

    Rows of the lookup without a region (totals) are left out; an outlet listed
    twice takes the larger region name.  ``strict`` raises on an unmapped outlet.
    """
    regions = bounded(lookup.filter("region is not null").groupBy(F.lower(F.trim("media")).alias("_k")).agg(F.max("region").alias("region")))
    out = articles.join(regions, F.lower(F.trim(articles["media"])) == F.col("_k"), "left").drop("_k")
    return out.withColumn("region", F.coalesce("region", F.raise_error(F.concat(F.lit("no region for outlet "), F.coalesce("media", F.lit("NULL")))).cast("string"))) if strict else out


def gold(first: Column, second: Column, strategy: str = "consensus") -> Column:
    """Labels of two coders as one set: ``consensus`` and ``majority`` intersect, ``union`` unites."""
    if strategy in ("consensus", "majority"):
        return F.array_intersect(first, second)
    if strategy == "union":
        return F.array_union(first, second)
    raise ValueError(f"unknown strategy {strategy}")
