"""Registry of the queries for training data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.llm import clusters, homoglyphs, leakage, neardup, neighbours, oracle, overlap, packing, pii, splits
from corpusloom.sources.tables import table

ORACLE_SQL: dict[str, str] = oracle.SQL


def _records(spark, d):
    return table(spark, d, "just_1_sub_validation_en").select("record_id", "text").union(table(spark, d, "just_1_sub_train_en").select("record_id", "text"))


def p5_found(spark, d):
    return homoglyphs.same_looking_pairs(table(spark, d, "just_1_sub_validation_en"), "record_id", "text")


def p5_forms(spark, d):
    return homoglyphs.consistent_texts(table(spark, d, "just_1_sub_validation_en"), "record_id", "text").select(F.col("key").alias("record_id"), "form")


def p6_found(spark, d):
    return splits.related_groups(_records(spark, d), table(spark, d, "ccf_processed_data").select("doc_id", "sentences"))


def _two_deliveries(spark, d, follow):
    """Validation records and all articles first, then the training records against the table that the first delivery left in the shared folder."""
    folder = f"{spark.sparkContext.getCheckpointDir()}/components-{uuid.uuid4().hex}"
    of = lambda name: table(spark, d, name).select("record_id", "text")
    first = follow(None, of("just_1_sub_validation_en"), table(spark, d, "ccf_processed_data").select("doc_id", "sentences")).saved(f"{folder}/1")
    return follow(first, of("just_1_sub_train_en"), None).saved(f"{folder}/2")


def p6_splits(spark, d):
    """Records of two deliveries: what the first one has placed stays, the second fills what is missing."""
    return _two_deliveries(spark, d, splits.delivered).members.select("record_id", "component", "split").distinct()


def p6_incremental(spark, d):
    """The groups of p6_found, from the table that two deliveries have built."""
    return splits.groups(_two_deliveries(spark, d, splits.extended).members.select("record_id", "component").distinct())


def p8_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "gold_test_items"))


def p8_report(spark, d):
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "gold_test_items"))


def p3_found(spark, d):
    return overlap.overlap_pairs(table(spark, d, "just_1_sub_validation_en"), table(spark, d, "just_1_sub_train_en"))


def p3_report(spark, d):
    return overlap.overlap_report(table(spark, d, "just_1_sub_validation_en"), table(spark, d, "just_1_sub_train_en"))


def p9_found(spark, d):
    return pii.findings(table(spark, d, "documents"), table(spark, d, "given_names"))


def p9_masked(spark, d):
    return pii.masked(table(spark, d, "documents"), table(spark, d, "given_names"))


def p1_found(spark, d):
    return neighbours.neighbour_pairs(table(spark, d, "ccf_sentence_embeddings"))


def p1_nearest(spark, d):
    return neighbours.nearest_of_queries(table(spark, d, "ccf_sentence_embeddings"))


def p2_found(spark, d):
    return clusters.found_clusters(table(spark, d, "ccf_sentence_embeddings"))


def p2_clusters(spark, d):
    return clusters.described_clusters(table(spark, d, "ccf_sentence_embeddings"))


def p7_packing(spark, d):
    return packing.packed_documents(table(spark, d, "documents"))


def p7_summary(spark, d):
    per = p7_packing(spark, d).groupBy("sequence_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    return per.agg(F.count("*").alias("n_sequences"), F.sum("n").alias("n_tokens"), F.sum("items").alias("n_pieces"), F.round(1 - F.sum("n") / (F.count("*") * packing.CAPACITY), 6).alias("unused_share"))


def p7_checks(spark, d):
    """What must hold of any packing: every text once and whole but for texts beyond the capacity, no sequence above it."""
    pieces = p7_packing(spark, d)
    fill = pieces.groupBy("sequence_id").agg(F.sum("n_tokens").alias("n")).agg(F.max("n").alias("most"))
    texts = pieces.groupBy("doc_id").agg(F.count("*").alias("k"), F.countDistinct("piece").alias("kinds"), F.max("piece").alias("last"), F.sum("n_tokens").alias("n"))
    whole = (F.col("k") == F.col("kinds")) & (F.col("last") + 1 == F.col("k")) & (F.col("k") == F.ceil(F.col("n") / packing.CAPACITY))
    return texts.agg(F.count("*").alias("n_documents"), F.coalesce(F.bool_and(whole), F.lit(True)).alias("whole")).crossJoin(fill.select((F.col("most") <= packing.CAPACITY).alias("within")))  # one row by one


P4_TABLES = ["just_1_sub_validation_en", "ccf_processed_data"]


def _texts(spark, d):
    """(tab, key, texts): validation records, and articles with all their units."""
    records = table(spark, d, "just_1_sub_validation_en").filter("record_id is not null and text is not null")
    units = table(spark, d, "ccf_processed_data").filter("doc_id is not null and sentences is not null")
    return (
        records.groupBy(F.lit(0).alias("tab"), F.col("record_id").alias("key")).agg(F.collect_set("text").alias("texts"))
        .union(units.groupBy(F.lit(1).alias("tab"), F.col("doc_id").alias("key")).agg(F.collect_set("sentences").alias("texts")))
    )


def _plain(spark, d):
    """The texts of both tables as one column, as they lie in the files."""
    return table(spark, d, "just_1_sub_validation_en").select("text").union(table(spark, d, "ccf_processed_data").select("sentences"))


def _tab_name():
    return F.element_at(F.array(*map(F.lit, P4_TABLES)), F.col("tab") + 1).alias("tab")


def p4_found(spark, d):
    return neardup.near_copy_pairs(_texts(spark, d), plain=_plain(spark, d)).select(_tab_name(), "key_a", "key_b")


def p4_groups(spark, d):
    return neardup.near_copy_groups(_texts(spark, d), plain=_plain(spark, d)).select(_tab_name(), "key", "class_key", "group_key", "n_links")


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups, "p7_packing": p7_packing, "p7_summary": p7_summary, "p7_checks": p7_checks, "p1_found": p1_found, "p1_nearest": p1_nearest, "p2_found": p2_found, "p2_clusters": p2_clusters, "p9_found": p9_found, "p9_masked": p9_masked, "p3_found": p3_found, "p3_report": p3_report, "p8_found": p8_found, "p8_report": p8_report, "p5_found": p5_found, "p5_forms": p5_forms, "p6_found": p6_found, "p6_splits": p6_splits, "p6_incremental": p6_incremental}
