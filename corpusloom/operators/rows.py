"""Choosing, repairing and merging rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.stages import checkpointed
from corpusloom.plans.taxonomy import CODES


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one with the largest ``order`` (NULL is smallest).

    Rows that tie on ``order`` are told apart by a hash of all their columns, so
    repeated rows give one and the choice doesn't depend on their order.  NULL keys
    form a group.  An empty table stays empty.
    """
    tie = F.xxhash64(*df.columns)
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), tie)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def delta_wins(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed union: rows of ``delta`` replace those of ``base`` with the same key; both have the same columns.

    A key that comes several times within a side keeps one row, the one with the smallest row hash.
    """
    columns = base.columns
    both = base.withColumn("_side", F.lit(0)).unionByName(delta.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_side"), F.xxhash64(*columns))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*columns)


def merged(base: DataFrame, updates: DataFrame, keys: list[str], column: str) -> DataFrame:
    """UPDATE .. FROM: where an update has a value for the key it replaces ``column``; NULL updates change nothing.

    An update key that comes several times counts with its largest value.
    """
    new = updates.groupBy(*keys).agg(F.max(column).alias("_new"))
    kept = [F.coalesce("_new", column).alias(column) if c == column else F.col(c) for c in base.columns]
    return base.join(new, keys, "left").select(*kept)


def excluded(df: DataFrame, keys: DataFrame, on: list[str], truthy: bool = True) -> DataFrame:
    """Rows whose key isn't in ``keys``.

    With ``truthy`` a key counts only if all its parts are neither NULL nor
    zero, so sentence 0 is never excluded.  Rows with a NULL key stay.
    """
    use = keys.select(*on).distinct()
    for c in on if truthy else ():
        use = use.filter(F.col(c).isNotNull() & (F.col(c) != 0))
    return df.join(use, on, "left_anti")


def excluded_texts(df: DataFrame, texts: DataFrame, language: str, text: str) -> DataFrame:
    """Rows whose (language, text) isn't among those of ``texts``; NULLs never match."""
    return df.join(texts.select(language, text).distinct(), [language, text], "left_anti")


def matching(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose composite key is listed: the IN-list as a semi join."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def not_blank(text: str) -> Column:
    """True where the text has a character that isn't white space; NULL texts are blank."""
    return F.coalesce(F.trim(text) != "", F.lit(False))


def as_count(column: str) -> Column:
    """Numeric text as an integer, anything else as 0."""
    return F.coalesce(F.expr(f"try_cast({column} as int)"), F.lit(0))


def detected_labels(df: DataFrame, deny: set[str]) -> DataFrame:
    """(code, total): numeric columns outside the deny-list with a positive sum, found in one aggregate."""
    names = [c for c, t in df.dtypes if c not in deny and t in ("int", "bigint", "smallint", "tinyint", "double", "float")]
    if not names:
        return df.sparkSession.createDataFrame([], "code string, total long")
    one = df.agg(*[F.sum(c).cast("long").alias(c) for c in names])
    return one.unpivot([], names, "code", "total").filter("total > 0")


def long_labels(df: DataFrame, keys: list[str], codes: list[str] = CODES, name: str = "value") -> DataFrame:
    """(keys, code, value): one row per label of each row, NULL labels left out."""
    return df.select(*keys, *codes).unpivot(keys, codes, "code", name).filter(F.col(name).isNotNull())


def dense_ids(df: DataFrame, order: list[str], name: str = "doc_id", start: int = 1) -> DataFrame:
    """Replaces ``name`` by 1, 2, 3, ... in a given order, without gathering the rows in one task.

    Rows are range-partitioned, sorted and numbered within their partition, and
    written once; partitions are counted over what was written, so that bounds
    of ranges, which are sampled anew with every run, can't move rows between
    the count and the numbers.  The order must be total for a fixed result;
    NULLs go first, and an empty table stays empty.
    """
    rows = df.drop(name)
    parts = rows.repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order)
    # monotonically_increasing_id counts within a partition in its lower 33 bits
    numbered = checkpointed(parts.withColumns({"_p": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = {r["_p"]: r["count"] for r in numbered.groupBy("_p").count().collect()}  # one row per partition
    offset, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, offset))
        offset += sizes[p]
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_p int, _offset long")
    return numbered.join(F.broadcast(table), "_p").withColumn(name, F.col("_at") + F.col("_offset") + start).select(name, *rows.columns)


def near_texts(df: DataFrame, key: str, text: str, similarity: float = 0.95, words: int = 5) -> DataFrame:
    """(<key>_a, <key>_b, similarity): different texts, in lower case, whose sets of ``words``-word shingles overlap that much.

    Equal texts are one, named by the smallest key; NULL, blank and shorter
    texts are like nothing.  Sets are ordered by hash; two sets of that similarity share one of
    their first shingles (as many as may be missing, and one), so an equi-join on those loses no
    pair, and only sets whose sizes allow it are compared in full.
    """
    clean = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    t = df.filter(not_blank(text)).groupBy(F.md5(F.lower(text)).alias("_m")).agg(F.min(key).alias("k"), F.min(clean).alias("t"))
    w = F.split("t", " ")
    shingles = F.transform(F.sequence(F.lit(1), F.size("w") - words + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))
    sets = t.select("k", w.alias("w")).filter(F.size("w") >= words).select("k", F.array_sort(F.array_distinct(shingles)).alias("s")).withColumn("n", F.size("s"))
    sets = checkpointed(sets)
    first = sets.select("k", "n", F.explode(F.slice("s", 1, F.col("n") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1)).alias("x"))
    other = first.select(F.col("k").alias("k2"), F.col("n").alias("n2"), "x")
    near = (F.col("k") < F.col("k2")) & (F.least("n", "n2") >= similarity * F.greatest("n", "n2") - 1e-9)
    pairs = first.join(other, "x").filter(near).select("k", "k2").distinct()
    full = pairs.join(sets.select("k", "s", "n"), "k").join(sets.select(F.col("k").alias("k2"), F.col("s").alias("s2"), F.col("n").alias("n2")), "k2")
    both = F.size(F.array_intersect("s", "s2"))
    like = full.select(F.col("k").alias(f"{key}_a"), F.col("k2").alias(f"{key}_b"), (both / (F.col("n") + F.col("n2") - both)).alias("similarity"))
    return like.filter(F.col("similarity") >= similarity - 1e-12).withColumn("similarity", F.round("similarity", 6))
