"""Closed forms of agreement and evaluation statistics over the four cells of a 2 x 2 table.

Cells: a = both 1, b = only the first 1, c = only the second 1, d = both 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: str) -> Column:
    return F.col(x).cast("double")


def cells(first: str, second: str) -> list[Column]:
    """The four counts as aggregates named a, b, c, d; rows with a NULL on either side count nowhere."""
    one, other = F.col(first), F.col(second)
    return [F.count_if((one == x) & (other == y)).alias(n) for n, x, y in (("a", 1, 1), ("b", 1, 0), ("c", 0, 1), ("d", 0, 0))]


def agreement() -> dict[str, Column]:
    """Agreement statistics from columns a, b, c, d.

    kappa is NULL if both coders are constant and equal; pi is then 1.  The S
    coefficient takes the number of values seen as chance term; ac1 is Gwet's.  alpha
    follows special cases for constant coders: 1 if equal, -1 if not, percent agreement if
    just one is constant.  Everything is NULL or 0 for n = 0 as noted.
    """
    a, b, c, d = map(_d, "abcd")
    n = a + b + c + d
    po = F.when(n > 0, (a + d) / n).otherwise(0.0)
    pe = ((a + b) * (a + c) + (c + d) * (b + d)) / (n * n)
    p = (2 * a + b + c) / (2 * n)
    pi_e = p * p + (1 - p) * (1 - p)
    n1, n0 = 2 * a + b + c, 2 * d + b + c
    first_constant, second_constant = ((a + b) == 0) | ((c + d) == 0), ((a + c) == 0) | ((b + d) == 0)
    both_values = (n1 > 0) & (n0 > 0)
    alpha = (
        F.when(first_constant & second_constant, F.when((b + c) == 0, 1.0).otherwise(-1.0))
        .when(first_constant | second_constant, po)
        .otherwise(1 - (b + c) * (2 * n - 1) / (n0 * n1))
    )
    ge = 2 * p * (1 - p)
    out = {
        "percent_agreement": po,
        "cohens_kappa": F.when((n > 0) & (pe < 1), (po - pe) / (1 - pe)),
        "scotts_pi": F.when(n > 0, F.when(pi_e < 1, (po - pi_e) / (1 - pi_e)).otherwise(1.0)),
        "s_coefficient": F.when(n > 0, F.when(both_values, 2 * po - 1).otherwise(1.0)),
        "gwet_ac1": F.when(n > 0, (po - ge) / (1 - ge)),
        "krippendorff_alpha": F.when(n > 0, alpha),
        "f1_agreement": F.when((2 * a + b + c) > 0, 2 * a / (2 * a + b + c)).otherwise(0.0),
        "prevalence_1": F.when(n > 0, (a + b) / n),
        "prevalence_2": F.when(n > 0, (a + c) / n),
    }
    return {k: F.round(v, 6).alias(k) for k, v in out.items()}


def pooled_alpha() -> Column:
    """Nominal two-coder alpha of summed cells, without the special cases."""
    a, b, c, d = map(_d, "abcd")
    n1, n0, n = 2 * a + b + c, 2 * d + b + c, a + b + c + d
    return F.when((n1 > 0) & (n0 > 0), 1 - (b + c) * (2 * n - 1) / (n0 * n1))


def fallback_alpha() -> Column:
    """Nominal two-coder alpha without the small-sample correction; 1 where only one value occurs."""
    a, b, c, d = map(_d, "abcd")
    n1, n0, n = 2 * a + b + c, 2 * d + b + c, a + b + c + d
    return F.round(F.when((n1 > 0) & (n0 > 0), 1 - (b + c) * 2 * n / (n0 * n1)).when(n > 0, 1.0), 6).alias("alpha")


def combined(f1_positive: Column, f1_macro: Column, weight: float = 0.98) -> Column:
    return weight * f1_positive + (1 - weight) * f1_macro


def softmax(scores: Column) -> Column:
    """Shares of an array of class scores; the largest score is taken off first, so none overflows.  NULL stays NULL."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def argmax(scores: str) -> Column:
    """Number from 0 of the largest score, the first of equal ones; NULL for NULL and empty arrays."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def evaluation(rounded: bool = True) -> dict[str, Column]:
    """Precision, recall, F1 of both classes and micro, macro, weighted F1; first = gold, second = prediction."""
    a, b, c, d = map(_d, "abcd")
    n = a + b + c + d
    p1, r1, f1 = ratio(a, a + c), ratio(a, a + b), ratio(2 * a, 2 * a + b + c)
    p0, r0, f0 = ratio(d, d + b), ratio(d, d + c), ratio(2 * d, 2 * d + b + c)
    out = {
        "precision_1": p1, "recall_1": r1, "f1_1": f1, "precision_0": p0, "recall_0": r0, "f1_0": f0,
        "f1_macro": (f1 + f0) / 2, "f1_micro": ratio(a + d, n), "f1_weighted": ratio((a + b) * f1 + (c + d) * f0, n),
    }
    return {k: (F.round(v, 6) if rounded else v).alias(k) for k, v in out.items()} | {"support_1": (F.col("a") + F.col("b")).alias("support_1"), "support_0": (F.col("c") + F.col("d")).alias("support_0")}
