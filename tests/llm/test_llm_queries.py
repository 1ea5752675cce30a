"""Queries over training data against their SQL, and all of them on the smallest tables."""

import glob
import os

import duckdb
import pytest

from corpusloom.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "p1_found": ["doc_id_a", "sentence_id_a", "doc_id_b", "sentence_id_b"], "p2_found": ["doc_id", "sentence_id", "cluster_doc_id", "cluster_sentence_id"],
    "p3_found": ["record_id", "train_record_id"], "p4_found": ["tab", "key_a", "key_b"], "p5_found": ["record_id_a", "record_id_b"],
    "p6_found": ["record_id", "group_record_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "kind", "value"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and {t for _, t in df.dtypes} <= {"bigint", "string"} and len(set(got)) == len(got)
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        assert sorted(got) == sorted(con.sql(f"select {', '.join(df.columns)} from ({ORACLE_SQL[name]})").fetchall())
