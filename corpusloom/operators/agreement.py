"""Agreement of two coders, evaluation against gold, reliability tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.metrics import agreement, cells, evaluation, pooled_alpha
from corpusloom.sources.sinks import report_csv

CELLS = ["a", "b", "c", "d"]


def contingency(pairs: DataFrame, by: list[str], first: str = "first", second: str = "second") -> DataFrame:
    """Four cells per group; rows with a NULL on either side are skipped, groups without a complete row too."""
    return pairs.groupBy(*by).agg(*cells(first, second)).filter("a + b + c + d > 0")


def per_label(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Agreement statistics of every label (and further group) from (code, first, second)."""
    keys = by or ["code"]
    return contingency(pairs, keys).select(*keys, F.expr("a + b + c + d").alias("n"), *agreement().values())


def overall(pairs: DataFrame) -> DataFrame:
    """One row: means of the per-label statistics (undefined ones left out) and the pooled alpha over all labels."""
    cell = contingency(pairs, ["code"])
    means = cell.select(*agreement().values()).agg(F.count("*").alias("n_labels"), *[F.round(F.avg(m), 6).alias(m) for m in ("percent_agreement", "cohens_kappa", "scotts_pi", "s_coefficient", "f1_agreement")])
    pooled = cell.agg(*[F.sum(x).alias(x) for x in CELLS]).select(F.round(pooled_alpha(), 6).alias("krippendorff_alpha"))
    return means.crossJoin(pooled)  # one row by one row


def progression(pairs: DataFrame, order: str, every: int = 100) -> DataFrame:
    """Statistics of growing prefixes: (code, n_units, ...) after each full ``every`` units of ``order`` (1, 2, ...).

    Cells are summed per step before running sums are taken, so windows see one row per step and label.  A last part that isn't full isn't shown.
    """
    step = F.ceil(F.col(order) / every).cast("long")
    by = pairs.withColumn("step", step).groupBy("code", "step").agg(*cells("first", "second"))
    w = Window.partitionBy("code").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    total = pairs.agg(F.max(order).alias("_last"))
    run = by.select("code", "step", *[F.sum(x).over(w).alias(x) for x in CELLS]).join(F.broadcast(total), F.col("step") * every <= F.col("_last"))
    stats = agreement()
    return run.select("code", (F.col("step") * every).alias("n_units"), *[stats[k] for k in ("percent_agreement", "cohens_kappa", "s_coefficient", "f1_agreement")])


def evaluated(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Wide evaluation per label and language, with ALL rows for both (gold = first, prediction = second)."""
    sets = [["code", "language"], ["code"], ["language"], []]
    cell = pairs.filter("first is not null and second is not null").groupingSets(sets, "code", "language").agg(*cells("first", "second"), F.grouping("code").alias("gc"), F.grouping("language").alias("gl"))
    return cell.select(
        F.when(F.col("gc") == 1, "ALL").otherwise(F.col("code")).alias("code"), F.when(F.col("gl") == 1, "ALL").otherwise(F.coalesce("language", F.lit("(none)"))).alias("language"), *evaluation().values())


def coder_counts(pairs: DataFrame) -> DataFrame:
    """(code, n, n_first, n_second, prevalence_1, prevalence_2): how often each coder gave a label."""
    stats = agreement()
    return contingency(pairs, ["code"]).select("code", F.expr("a + b + c + d").alias("n"), F.expr("a + b").alias("n_first"), F.expr("a + c").alias("n_second"), stats["prevalence_1"], stats["prevalence_2"])


def within(df: DataFrame, column: str, expected: float, tolerance: float, name: str) -> DataFrame:
    """Adds ``name``: whether a value is as expected; NULL is not."""
    return df.withColumn(name, F.coalesce(F.abs(F.col(column) - expected) <= tolerance, F.lit(False)))


def phase_cells(pairs: DataFrame, order: str, first: int) -> DataFrame:
    """(code, part, a, b, c, d) for all units (full), the first ones by ``order`` (before) and the rest (after).

    Only the two parts are counted over the rows; full is their sum.
    """
    parts = contingency(pairs.withColumn("part", F.when(F.col(order) <= first, "before").otherwise("after")), ["code", "part"])
    return parts.unionByName(parts.groupBy("code").agg(*[F.sum(x).alias(x) for x in CELLS]).withColumn("part", F.lit("full")))


def per_category(cells: DataFrame, categories: DataFrame, statistics: list[str]) -> DataFrame:
    """(number, code, <statistic>_<part> ...) for every category; those without units have NULLs, a label without a category raises."""
    known = categories.select("number", "code")
    stats = agreement()
    wide = cells.select("code", "part", *[stats[s] for s in statistics]).groupBy("code").agg(
        *[F.max(F.when(F.col("part") == p, F.col(s))).alias(f"{s}_{p}") for p in ("full", "before", "after") for s in statistics])
    out = known.join(wide.withColumnRenamed("code", "_code"), F.col("code") == F.col("_code"), "full")
    strict = F.when(F.col("number").isNotNull(), F.col("number")).otherwise(F.raise_error(F.concat(F.lit("no category for label "), F.col("_code"))).cast(known.schema["number"].dataType))
    return out.select(strict.alias("number"), "code", *wide.columns[1:])


def export(folder: str, tables: dict[str, DataFrame], order: dict[str, list[str]]) -> None:
    """The tables of a reliability report (overall, per label, before and after, progression), each as one sorted CSV file."""
    for name, df in tables.items():
        report_csv(df, f"{folder}/{name}", df.columns, order[name], 4)


def tier(f1: str | Column, kappa: str | Column) -> Column:
    """no_data, C, A or B by macro F1 and kappa; the order of the rules matters."""
    f, k = (F.col(x) if isinstance(x, str) else x for x in (f1, kappa))
    return (
        F.when(f.isNull(), "no_data").when(f < 0.60, "C").when(k.isNotNull() & (k < 0.40), "C")
        .when((f >= 0.80) & (k.isNull() | (k >= 0.60)), "A").otherwise("B")
    )


def paradox(f1: str | Column, kappa: str | Column) -> Column:
    """High F1 beside low kappa; NULL on either side is no paradox."""
    f, k = (F.col(x) if isinstance(x, str) else x for x in (f1, kappa))
    return F.coalesce((f >= 0.70) & (k < 0.40), F.lit(False))


def tiered(scores: DataFrame, excluded: list[str], f1: str = "f1_macro_all", kappa: str = "cohens_kappa_blind_phase") -> DataFrame:
    """Adds tier, paradox and exclusion_reason; excluded codes are C whatever their scores."""
    out = F.col("code").isin(excluded) if excluded else F.lit(False)
    return scores.withColumns({
        "tier": F.when(out, "C").otherwise(tier(f1, kappa)), "paradox": paradox(f1, kappa), "exclusion_reason": F.when(out, "excluded"),
    })
