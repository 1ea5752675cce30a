"""Sinks: Parquet, CSV and JSON lines; all commit atomically and can be run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "overwrite") -> None:
    """ZSTD Parquet, partitioned on request."""
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def table_if_absent(df: DataFrame, name: str) -> None:
    """Creates a table once; a second call changes nothing."""
    df.write.mode("ignore").saveAsTable(name)


def report_csv(df: DataFrame, path: str, columns: list[str], order: list[str], decimals: int = 3) -> None:
    """A small report as one sorted CSV file: fixed column order, fractions with fixed decimals, NULL as --.

    Meant for reports; it writes one file.
    """
    text = [F.when(F.col(c).isNull(), "--").otherwise(F.format_string(f"%.{decimals}f", c) if t in ("double", "float") else F.col(c).cast("string")).alias(c) for c, t in df.select(*columns).dtypes]
    df.orderBy(*order).select(*text).coalesce(1).write.mode("overwrite").csv(path, header=True)


def appended_csv(df: DataFrame, path: str) -> None:
    """Rows added to a log folder."""
    df.write.mode("append").csv(path, header=True)


def jsonl(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """JSON lines in UTF-8; structs stay nested, NULL fields are left out."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).json(path)


def batched(df: DataFrame, path: str, key: str, batches: int) -> int:
    """Parquet in batches by a hash of the key, one folder each; a batch that is complete isn't written again.  Returns the batches written.

    A folder without its success mark is what an interrupted run left; it is replaced.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    done = 0
    for n in range(batches):
        folder = f"{path}/batch={n}"
        mark = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            parquet(df.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == n), folder)
            done += 1
    return done


def float_vectors(df: DataFrame, column: str) -> DataFrame:
    """The vector column as an array of single-precision numbers, as vector stores export it."""
    return df.withColumn(column, F.col(column).cast("array<float>"))


def annotation_records(df: DataFrame, codes: list[str], text: str, meta: list[str]) -> DataFrame:
    """(text, label, meta): positive labels as a list, descriptive columns as a struct; NULL descriptions get a default."""
    labels = F.filter(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in codes]), lambda x: x.isNotNull())
    kinds = dict(df.dtypes)
    described = [(F.coalesce(c, F.lit(f"{c} : not provided")) if kinds[c] == "string" else F.col(c)).alias(c) for c in meta]
    return df.select(F.col(text).alias("text"), labels.alias("label"), F.struct(*described).alias("meta"))
