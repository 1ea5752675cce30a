"""Units rolled up to articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import entity
from corpusloom.plans.taxonomy import CODES, FAMILIES, FRAMES


def top_frame(prefix: str = "prop_") -> Column:
    """The frame with the largest share; the first in canonical order wins a tie; NULL if none is positive."""
    best = F.greatest(*[F.col(prefix + f) for f in FRAMES])
    out = F.when(best <= 0, F.lit(None).cast("string"))
    for f in FRAMES:
        out = out.when(F.col(prefix + f) == best, F.lit(f))
    return out


def entropy(prefix: str = "prop_") -> Column:
    """Shannon entropy (natural logarithm) of the frame shares brought to sum 1; 0 if none is positive."""
    parts = [F.col(prefix + f) for f in FRAMES]
    total = sum(parts[1:], parts[0])
    terms = [F.when(p > 0, -(p / total) * F.log(p / total)).otherwise(0.0) for p in parts]
    return F.when(total > 0, sum(terms[1:], terms[0])).otherwise(0.0)


def article_aggregates(units: DataFrame) -> DataFrame:
    """One row per doc_id: units by language, share of units with each label (NULL counts as 0), main frame, entropy, kinds of sub-labels.

    One shuffle with partial sums, whatever the number of labels.  ``units`` must
    have one row per unit.  A NULL doc_id is left out.
    """
    sums = units.filter("doc_id is not null").groupBy("doc_id").agg(
        F.count("*").alias("n_sentences"), F.count_if(F.col("language") == "EN").alias("n_sentences_en"), F.count_if(F.col("language") == "FR").alias("n_sentences_fr"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in CODES],
    )
    shares = sums.select("doc_id", "n_sentences", "n_sentences_en", "n_sentences_fr", *[(F.col(c) / F.col("n_sentences")).alias(f"prop_{c}") for c in CODES])
    kinds = {"messenger": "messenger", "event": "event", "solution": "solution"}
    return shares.select(
        "*", top_frame().alias("top_frame"), F.greatest(*[f"prop_{f}" for f in FRAMES]).alias("top_frame_prop"), entropy().alias("entropy_frames"),
        *[sum([(F.col(f"prop_{c}") > 0).cast("int") for c in FAMILIES[k]], F.lit(0)).alias(f"n_unique_{name}_subs") for k, name in kinds.items()],
    )


ENTITIES = "PER array<string>, ORG array<string>, LOC array<string>"
KINDS = ("PER", "ORG", "LOC")


def named(kind: str, names: Column) -> Column:
    """Array of (kind, name) from an array of names; NULL gives an empty one."""
    return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))


def exploded(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, name): one row per entity of a unit's JSON; broken JSON, NULL and missing kinds hold none."""
    parsed = units.select(*keys, F.from_json("ner_entities", ENTITIES).alias("_e"))
    return parsed.select(*keys, F.explode(F.concat(*[named(k, F.col(f"_e.{k}")) for k in KINDS])).alias("_x")).select(*keys, "_x.kind", "_x.name")


def entity_rollup(units: DataFrame) -> DataFrame:
    """One row per doc_id: distinct entities of each kind (sorted), how many, and in how many units.

    Broken JSON, NULL and missing kinds hold no entities; names compare as they
    are written.  Lists and counts come from one aggregate.
    """
    rows = units.filter("doc_id is not null").select("doc_id", F.from_json("ner_entities", ENTITIES).alias("e"))
    names = rows.groupBy("doc_id").agg(
        *[F.count_if(F.coalesce(F.size(f"e.{k}"), F.lit(0)) > 0).alias(f"n_sentences_with_{k.lower()}") for k in KINDS],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(f"e.{k}")))).alias(f"entities_{k.lower()}") for k in KINDS],
    )
    clean = lambda k: F.filter(f"entities_{k.lower()}", lambda x: x.isNotNull())
    return names.select(
        "doc_id", *[clean(k).alias(f"entities_{k.lower()}") for k in KINDS], *[F.size(clean(k)).alias(f"n_unique_{k.lower()}") for k in KINDS],
        *[f"n_sentences_with_{k.lower()}" for k in KINDS],
    )


def entity_mentions(units: DataFrame) -> DataFrame:
    """(kind, name, doc_id), distinct: which articles name which entity; pure punctuation and single characters are left out."""
    return exploded(units, ["doc_id"]).select("kind", "name", "doc_id").filter(entity("name")).distinct()


def pivoted(df: DataFrame, key: str, column: str, values: list, value: str) -> DataFrame:
    """One row per key with a column per value; a key that has a value twice stops the job, a missing one is NULL."""
    one = lambda v: F.when(F.count_if(F.col(column) == v) > 1, F.raise_error(F.lit(f"more than one row for {v}")).cast(df.schema[value].dataType)).otherwise(F.max(F.when(F.col(column) == v, F.col(value))))
    return df.groupBy(key).agg(*[one(v).alias(v) for v in values])
