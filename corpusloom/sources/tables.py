"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table as a lazy scan; filters and column selection reach the files."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
