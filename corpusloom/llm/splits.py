"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.arrow import batch, strings
from corpusloom.llm.components import components
from corpusloom.llm.homoglyphs import digest
from corpusloom.llm.ranking import ranked
from corpusloom.llm.textform import consistent_form
from corpusloom.plans.stages import checkpointed

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, forms = [], []
        for k, t in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
            form = consistent_form(t)
            if form and form.strip():
                keys.append(k)
                forms.append(digest(form))
        yield batch(key=pa.array(keys, pa.int64()), form=pa.array(forms, pa.binary()))


def form_digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form): 128-bit digest of the consistent form of each text that isn't blank."""
    rows = df.select(F.col(key).cast("long"), F.col(text)).filter(f"{key} is not null and {text} is not null")
    return rows.mapInArrow(_digests, "key long, form binary")


@dataclass
class State:
    """The persisted component table: what earlier deliveries have settled.

    ``members`` has (record_id, form, component, split), ``docs`` the component
    of each article that holds a record's text, ``forms`` the (form, doc) of all articles.
    """

    members: DataFrame
    docs: DataFrame
    forms: DataFrame

    def saved(self, folder: str) -> State:
        """Written to a folder that all executors share, and read from there."""
        for name in ("members", "docs", "forms"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        return State.read(self.members.sparkSession, folder)

    @staticmethod
    def read(spark: SparkSession, folder: str) -> State:
        return State(*(spark.read.parquet(f"{folder}/{name}") for name in ("members", "docs", "forms")))

    @staticmethod
    def empty(spark: SparkSession) -> State:
        return State(*(spark.createDataFrame([], x) for x in ("record_id long, form binary, component long, split string", "doc long, component long", "form binary, doc long")))


def extended(state: State | None, records: DataFrame, articles: DataFrame | None) -> State:
    """The component table with a delivery added: records (record_id, text) and articles (doc_id, sentences).

    Records with the same text, or texts of the same article, share a component,
    directly or over other records and articles, of this delivery or earlier
    ones; texts compare in consistent form.  Only edges of what is new are
    looked at: an earlier component comes in as one node.  A component's name is its
    smallest record_id, so merged ones are renamed, by pointer jumping.  Records
    with NULL or blank text stand alone; articles that hold no record's text
    never enter the graph.  Record ids are not negative.  ``split`` is NULL for new records.
    """
    spark = records.sparkSession
    first = state is None
    old = State.empty(spark) if first else state
    given = form_digests(records, "record_id", "text").distinct().withColumnRenamed("key", "record_id")
    fresh = checkpointed(given if first else given.join(old.members.select("record_id", "form"), ["record_id", "form"], "left_anti"))
    named = fresh.groupBy("form").agg(F.min("record_id").alias("rep"))
    edges = fresh.join(named, "form").select(F.col("rep").alias("a"), F.col("record_id").alias("b"))
    added = None if articles is None else form_digests(articles, "doc_id", "sentences").distinct().select("form", F.col("key").alias("doc"))
    forms = old.forms if added is None else added if first else old.forms.union(added).distinct()
    node = (-F.col("doc") - 1).alias("a")  # articles have negative nodes
    if not (first and added is None):
        edges = edges.union(forms.join(named, "form").select(node, F.col("rep").alias("b")).distinct())
    if not first:
        of_form = old.members.filter("form is not null").groupBy("form").agg(F.min("component").alias("component"))
        of_record = old.members.select("record_id", "component").distinct()
        if added is not None:
            edges = edges.union(added.join(of_form, "form").select(node, F.col("component").alias("b")).distinct())
        edges = checkpointed(edges)
        touched = edges.filter("a < 0").select((-F.col("a") - 1).alias("doc")).distinct()
        edges = edges.union(old.docs.join(touched, "doc", "left_semi").select(node, F.col("component").alias("b")))
        edges = edges.union(named.join(of_form, "form").select(F.col("component").alias("a"), F.col("rep").alias("b"))).union(fresh.join(of_record, "record_id").select(F.col("component").alias("a"), F.col("record_id").alias("b")))
    linked = components(edges)
    names = linked.filter("node >= 0").groupBy("component").agg(F.min("node").alias("name"))
    found = checkpointed(linked.join(names, "component").select("node", "name"))
    of = found.filter("node >= 0")
    members = fresh.join(of.withColumnRenamed("node", "record_id"), "record_id", "left").select("record_id", "form", F.coalesce("name", "record_id").alias("component"), F.lit(None).cast("string").alias("split"))
    seen = members.select("record_id") if first else members.select("record_id").union(old.members.select("record_id"))
    alone = records.select(F.col("record_id").cast("long")).filter("record_id is not null").distinct().join(seen, "record_id", "left_anti")
    members = members.union(alone.select("record_id", F.lit(None).cast("binary"), F.col("record_id").alias("component"), F.lit(None).cast("string")))
    docs = found.filter("node < 0").select((-F.col("node") - 1).alias("doc"), F.col("name").alias("component"))
    if not first:
        renamed = lambda t: t.join(of.select(F.col("node").alias("component"), "name"), "component", "left").withColumn("component", F.coalesce("name", "component")).drop("name")
        members = renamed(old.members).select("record_id", "form", "component", "split").union(members)
        docs = renamed(old.docs).select("doc", "component").union(docs).distinct()
    return State(members, docs, forms)


def related_records(records: DataFrame, articles: DataFrame | None) -> DataFrame:
    """(record_id, component) of a first delivery; see :func:`extended`."""
    return extended(None, records, articles).members.select("record_id", "component").distinct()


def groups(comp: DataFrame) -> DataFrame:
    """(record_id, group_record_id) of records in a group of at least two."""
    large = comp.groupBy("component").count().filter("count >= 2").select("component")
    return comp.join(large, "component").select("record_id", F.col("component").alias("group_record_id"))


def related_groups(records: DataFrame, articles: DataFrame) -> DataFrame:
    return groups(related_records(records, articles))


def delivered(state: State | None, records: DataFrame, articles: DataFrame | None, shares: dict[str, float] | None = None) -> State:
    """The component table with a delivery added and every record in a split; see :func:`assigned_splits`."""
    new = extended(state, records, articles)
    members = checkpointed(new.members)
    before = members.filter("split is not null").select("record_id", "split").distinct()
    placed = assigned_splits(members.select("record_id", "component").distinct(), shares, before).select("record_id", F.col("split").alias("_split"))
    return State(members.join(placed, "record_id").select("record_id", "form", "component", F.col("_split").alias("split")), new.docs, new.forms)


def filled(sizes: list[tuple[int, int]], deficit: dict[str, float]) -> list[tuple[int, int, str, int]]:
    """How many components of each size go to each split.

    ``sizes`` has (size, components), largest first.  Each share of a size goes
    where most is missing; shares are cut so that no split is overfilled before the others.
    Returns (size, first rank, split, number).
    """
    plan = []
    for size, number in sizes:
        at = 0
        while at < number:
            want = sorted(deficit, key=lambda s: (-deficit[s], s))
            gap = deficit[want[0]] - (deficit[want[1]] if len(want) > 1 else 0)
            take = min(number - at, max(1, int(gap // size)))
            if gap < size and number - at > 100:  # level: deal out in proportion to what is missing
                total = sum(max(v, 0) for v in deficit.values()) or 1
                rest = number - at
                for s in want:
                    n = int(rest * max(deficit[s], 0) / total)
                    if n:
                        plan.append((size, at, s, n))
                        at += n
                        deficit[s] -= n * size
                if at < number and number - at > 100:
                    plan.append((size, at, want[0], number - at))
                    deficit[want[0]] -= (number - at) * size
                    at = number
                continue
            plan.append((size, at, want[0], take))
            at += take
            deficit[want[0]] -= take * size
    return plan


def assigned_splits(comp: DataFrame, shares: dict[str, float] | None = None, before: DataFrame | None = None) -> DataFrame:
    """(record_id, component, split): new components fill what each split lacks.

    ``before`` is the persisted table (record_id, split) of earlier runs: a
    component whose records had one split keeps it; one whose records had
    several (a merge across splits) is ``quarantined``.  New components are
    placed by size, largest first, where most records are missing.  The driver
    sees only one row per distinct component size.  Records that are only in
    ``before`` count toward the proportions but aren't returned.
    """
    shares = shares or SPLITS
    total = sum(shares.values())
    comp = checkpointed(comp)
    if before is None:
        before = comp.select("record_id", F.lit(None).cast("string").alias("split")).limit(0)
    known = comp.join(before.select("record_id", "split").dropDuplicates(["record_id"]), "record_id", "left")
    old = checkpointed(known.groupBy("component").agg(F.count("*").alias("size"), F.min("split").alias("low"), F.max("split").alias("high")))
    kept = old.filter("low is not null").select("component", F.expr("if(low = high, low, 'quarantined')").alias("split"), "size")
    new = old.filter("low is null").select("component", "size")
    held = {r["split"]: r["n"] for r in kept.groupBy("split").agg(F.sum("size").alias("n")).collect()}  # as many rows as splits
    gone = before.select("record_id", "split").dropDuplicates(["record_id"]).filter("split is not null").join(comp.select("record_id"), "record_id", "left_anti")
    for r in gone.groupBy("split").agg(F.count("*").alias("n")).collect():  # as many rows as splits
        held[r["split"]] = held.get(r["split"], 0) + r["n"]
    sizes = [(r["size"], r["n"]) for r in new.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()]  # distinct sizes only
    everything = sum(n for s, n in held.items() if s != "quarantined") + sum(s * n for s, n in sizes)
    plan = filled(sizes, {s: everything * p / total - held.get(s, 0) for s, p in shares.items()})
    spark = comp.sparkSession
    ranges = spark.createDataFrame(plan or [(-1, 0, "", 0)], "size long, first long, split string, number long")
    placed = ranked(new.withColumn("order", F.xxhash64("component")), "size", ["order", "component"])
    placed = placed.join(F.broadcast(ranges), "size").filter("rank >= first and rank < first + number").select("component", "split")
    return comp.join(placed.union(kept.select("component", "split")), "component").select("record_id", "component", "split")
