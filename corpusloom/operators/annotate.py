"""Hierarchical labels on units: lexicon surrogate, gating, resuming, batch inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.taxonomy import PARENT

# Words that stand for a label where no trained model is at hand.
LEXICON = {
    "economic_frame": "cost|price|tariff|subsid|premium|budget|loan|dollars|million",
    "eco_cost": "cost|premium|tariff",
    "political_frame": "council|tribunal|federal|provincial|election|ordinance|conseil",
    "pol_action": "halted|reviewed|approved|ordinance",
    "environmental_frame": "marsh|glacier|salmon|caribou|reservoir|habitat|wetland|rivi",
    "env_habitat": "habitat|marsh|wetland",
}


def by_lexicon(units: DataFrame, text: str, lexicon: dict[str, str]) -> DataFrame:
    """Adds a 0/1 column per label: whether its pattern occurs; a child is NULL unless its parent is 1.

    NULL text has no match.  Columns of the same names are replaced.
    """
    hit = {c: F.coalesce(F.col(text), F.lit("")).rlike(p) for c, p in lexicon.items()}
    return units.withColumns({c: F.when(hit[PARENT[c]], hit[c].cast("int")) if c in PARENT else hit[c].cast("int") for c in lexicon})


def gated(units: DataFrame, parents: dict[str, str] = PARENT) -> DataFrame:
    """Children that aren't under a positive parent become NULL."""
    return units.withColumns({c: F.when(F.col(p) == 1, F.col(c)) for c, p in parents.items() if c in units.columns and p in units.columns})


def blinded(df: DataFrame, column: str = "label") -> DataFrame:
    """Labels wiped for blind coding; a table without the column stays as it is."""
    return df.withColumn(column, F.array().cast("array<string>")) if column in df.columns else df


def unlabelled(df: DataFrame, label: str, text: str, parent: str | None = None, language: str | None = None, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows with text whose label is missing, on request only under a positive parent, of one language, or the first ``limit`` by ``order``."""
    out = df.filter(F.col(label).isNull() & F.col(text).isNotNull())
    out = out.filter(F.col(parent) == 1) if parent else out
    out = out.filter(F.col("language") == language) if language else out
    return (out.orderBy(*order) if order else out).limit(limit) if limit is not None else out


def resumed(column: str, fresh: Column) -> Column:
    """A label as it is, or the fresh value where it is NULL."""
    return F.coalesce(F.col(column), fresh).alias(column)


def gating_violations(units: DataFrame, parents: dict[str, str] = PARENT) -> DataFrame:
    """(code, against, under): set labels without and with a positive parent; one aggregate for all labels."""
    sums = units.agg(*[x for c, p in parents.items() for x in (
        F.count_if(F.col(c).isNotNull() & (F.coalesce(F.col(p), F.lit(0)) != 1)).alias(f"{c}|against"), F.count_if(F.col(c).isNotNull() & (F.col(p) == 1)).alias(f"{c}|under"))])
    each = F.array(*[F.struct(F.lit(c).alias("code"), F.col(f"`{c}|against`").alias("against"), F.col(f"`{c}|under`").alias("under")) for c in parents])
    return sums.select(F.explode(each).alias("x")).select("x.*")


def inferred(rows: DataFrame, keys: list[str], text: str, load: Callable[[], Callable[[list[str]], list[int]]], batch: int = 5000) -> DataFrame:
    """(keys, prediction) by a Python model, loaded once per partition and called on batches.

    A batch that fails is tried row by row; a row that fails gets NULL.  NULL
    text isn't sent to the model and gets NULL.  Filter before calling: a model is never evaluated for rows it isn't needed on.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields) + ", prediction int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def one(t: str) -> int | None:
            try:
                return int(model([t])[0])
            except Exception:
                return None

        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                there = part[text].notna()
                texts = part.loc[there, text].tolist()
                try:
                    found: list = [int(x) for x in model(texts)] if texts else []
                    if len(found) != len(texts):
                        raise ValueError("one prediction per text")
                except Exception:
                    found = [one(t) for t in texts]
                out = part[keys].copy()
                out["prediction"] = pd.array([None] * len(part), dtype="Int32")
                out.loc[there, "prediction"] = pd.array(found, dtype="Int32")
                yield out

    return rows.select(*keys, text).mapInPandas(run, schema)
