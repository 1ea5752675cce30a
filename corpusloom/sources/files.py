"""Text sources: CSV, JSON lines in three tempers, label lists, training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATION = "text string, label array<string>, meta struct<doc_id: bigint, sentence_id: bigint, language: string, date: string, media: string, title: string>"
EPOCHS = "epoch int, train_loss double, val_loss double, precision_0 double, recall_0 double, f1_0 double, support_0 int, precision_1 double, recall_1 double, f1_1 double, support_1 int, macro_f1 double"


def csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header and a declared schema; ``columns`` are kept by name, those absent are passed over."""
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    return df.select(*[c for c in df.columns if c in columns]) if columns is not None else df


def jsonl(spark: SparkSession, path: str, schema: str = ANNOTATION, malformed: str = "null") -> DataFrame:
    """JSON lines; blank lines are skipped.

    ``malformed``: ``null`` gives a row of NULLs, ``skip`` leaves the line out,
    ``fail`` stops the job.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    mode = {"null": "PERMISSIVE", "skip": "PERMISSIVE", "fail": "FAILFAST"}[malformed]
    options = {"mode": mode, "columnNameOfCorruptRecord": "_bad"}
    wide = schema if malformed == "fail" else f"{schema}, _bad string"
    rows = lines.select(F.from_json("value", wide, options).alias("r")).select("r.*")
    if malformed == "fail":
        return rows
    return (rows.filter("_bad is null") if malformed == "skip" else rows).drop("_bad")


def numbered_jsonl(spark: SparkSession, path: str, schema: str = ANNOTATION) -> DataFrame:
    """JSON lines of files that each fit one task; a malformed line stops the job and names its file and line number."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_f"), F.posexplode(F.split("value", r"\r?\n")).alias("_at", "value"))
    rows = lines.filter(F.trim("value") != "").select("_f", "_at", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    wrong = F.raise_error(F.concat("_f", F.lit(", line "), F.col("_at") + 1)).cast("string")
    return rows.select("r.*", F.when(F.col("r._bad").isNotNull(), wrong).alias("_checked")).filter(F.col("_checked").isNull()).drop("_bad", "_checked")


def label_list(spark: SparkSession, path: str) -> DataFrame:
    """(label, position) from a JSON array of names."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("labels"))
    return whole.select(F.posexplode("labels").alias("position", "label")).select("label", "position")


def jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table or subquery behind JDBC; ``partition`` is (column, lowest, highest, number of parts) for parallel reading."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        c, low, high, n = partition
        reader = reader.option("partitionColumn", c).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    return reader.load()


def training_logs(spark: SparkSession, pattern: str, schema: str = EPOCHS) -> DataFrame:
    """Epoch rows of many logs; the folder's name <category>_<EN|FR> gives category and language."""
    df = spark.read.csv(pattern, header=True, schema=schema)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.select(F.regexp_replace(folder, "_(EN|FR)$", "").alias("category"), F.regexp_extract(folder, "_(EN|FR)$", 1).alias("language"), *df.columns)


def training_table(logs: DataFrame) -> DataFrame:
    """One row per (category, language): epochs, and the epoch with the best combined score (the first of equal ones) with its F1 values."""
    score = 0.98 * F.col("f1_1") + 0.02 * F.col("macro_f1")
    best = F.max_by(F.struct("epoch", "f1_1", "macro_f1"), F.struct(score, -F.col("epoch"))).alias("b")
    return logs.filter("epoch is not null").groupBy("category", "language").agg(F.max("epoch").alias("epochs"), best).select("category", "language", "epochs", F.col("b.epoch").alias("best_epoch"), F.col("b.f1_1").alias("f1_1"), F.col("b.macro_f1").alias("macro_f1"))


def paired_files(spark: SparkSession, names: DataFrame, name: str = "name") -> DataFrame:
    """Names of training files that have a validation file: ..._train_<L>.jsonl and ..._validation_<L>.jsonl."""
    train = names.filter(F.col(name).rlike(r"_train_(EN|FR)\.jsonl$")).select(name, F.regexp_replace(name, r"_train_(EN|FR)\.jsonl$", "_validation_$1.jsonl").alias("_v"))
    return train.join(names.select(F.col(name).alias("_v")).distinct(), "_v", "left_semi").select(name)
