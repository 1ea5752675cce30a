"""Registration of queries and the tables they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.rows import latest
from corpusloom.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, folder) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def units(spark, d, *columns: str, by: str | None = None) -> DataFrame:
    """Units, one row per (doc_id, sentence_id), as last loaded; only the keys, the load time and ``columns`` are read.

    ``by``: rows are partitioned by that key once, for the window here and a rollup by it after; rows without it are left out.
    """
    t = table(spark, d, "ccf_processed_data").select(*dict.fromkeys(["doc_id", "sentence_id", "loaded_at", *columns]))
    return latest(t.filter(F.col(by).isNotNull()).repartition(by) if by else t, ["doc_id", "sentence_id"], "loaded_at")


def articles(spark, d, *columns: str) -> DataFrame:
    """Articles, one row per doc_id, as last loaded; only the key, the load time and ``columns`` are read."""
    t = table(spark, d, "ccf_full_data")
    return latest(t.select(*dict.fromkeys(["doc_id", "loaded_at", *columns])), ["doc_id"], "loaded_at")


UNITS = "units as (select * from ccf_processed_data qualify row_number() over (partition by doc_id, sentence_id order by loaded_at desc) = 1)"
ARTICLES = "articles as (select * from ccf_full_data qualify row_number() over (partition by doc_id order by loaded_at desc) = 1)"

__all__ = ["ARTICLES", "F", "ORACLE_SQL", "QUERIES", "UNITS", "articles", "query", "table", "units"]
