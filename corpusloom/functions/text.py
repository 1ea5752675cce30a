"""Expressions over text, dates and vectors; all run inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BREAK = "\u0001"


def sentences(text: str | Column) -> Column:
    """Sentences of a text: split behind . ! ? and white space; NULL and blank texts have one empty sentence."""
    c = F.col(text) if isinstance(text, str) else text
    return F.split(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"([.!?])\s+", "$1" + BREAK), BREAK)


def two_sentence_units(parts: str | Column) -> Column:
    """Unit 1 is the first sentence, unit i is sentences i-1 and i; as many units as sentences."""
    c = F.col(parts) if isinstance(parts, str) else parts
    return F.transform(c, lambda s, i: F.when(i == 0, s).otherwise(F.concat_ws(" ", F.get(c, i - 1), s)))


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Accents composed with their letter (NFC), in Arrow batches, as Spark has no expression for it."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def folded(text: str | Column) -> Column:
    """Composed text with typographic apostrophes and quotation marks as plain ones; NULL stays NULL."""
    return F.translate(composed(text), "‘’“”ʼ", "''\"\"'")


def spans_of(text: str, pattern: str) -> Column:
    """Array of (start, stop), from 0 and exclusive, of the matches of a pattern that can't match nothing."""
    # the text behind each match begins where the match ends, so the parts between matches give the offsets
    gaps, found = F.split(text, pattern, -1), F.expr(f"regexp_extract_all({text}, '{pattern}', 0)")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        stop = begin + F.length(x["hit"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), stop.alias("stop")))).alias("out"))

    pairs = F.transform(found, lambda h, i: F.struct(F.get(gaps, i).alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def merged_spans(text: str, offsets: str) -> Column:
    """Texts of the (start, stop) spans, sorted; spans with one to five signs between them, none a letter or digit, become one.

    NULL text gives NULL, no spans an empty array.
    """
    c = F.col(text)
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        gap = F.substring(c, last["stop"] + 1, x["start"] - last["stop"])
        near = gap.rlike(r"^[^\p{L}\p{N}_]{1,5}$")
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), x["stop"].alias("stop"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(near, grown).otherwise(F.concat(acc, F.array(x)))

    return F.transform(F.aggregate(F.array_sort(offsets), empty, step), lambda x: F.substring(c, x["start"] + 1, x["stop"] - x["start"]))


def dashed(text: str | Column) -> Column:
    """NULL as --."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string"), F.lit("--"))


def thousands(number: str | Column) -> Column:
    """Whole numbers with separators, NULL as --."""
    return dashed(F.format_number(number, 0))


def percent(share: Column, decimals: int = 1) -> Column:
    """A share as per cent with fixed decimals, NULL as --."""
    return dashed(F.format_string(f"%.{decimals}f%%", 100 * share))


def parsed_date(text: str) -> Column:
    """Date of yyyy-mm-dd, yyyy/mm/dd or mm-dd-yyyy text; anything else is NULL."""
    return F.coalesce(*[F.expr(f"try_to_date({text}, '{f}')") for f in ("yyyy-MM-dd", "yyyy/MM/dd", "MM-dd-yyyy")])


def year_of(text: str, low: int = 1900, high: int = 2100) -> Column:
    """Year of a date in any of the known shapes, or of a bare year; out of range is NULL."""
    y = (
        F.when(F.col(text).rlike(r"^\d{4}([-/]|$)"), F.substring(text, 1, 4))
        .when(F.col(text).rlike(r"^\d{2}-\d{2}-\d{4}$"), F.substring(text, 7, 4))
        .cast("int")
    )
    return F.when(y.between(low, high), y)


def period(year: str | Column, kind: str) -> Column:
    """Label of the year, decade (1990s) or five years (1990-1994) a year falls in; NULL gives Unknown."""
    y = F.col(year) if isinstance(year, str) else year
    if kind == "year":
        label = y.cast("string")
    elif kind == "decade":
        label = F.concat((F.floor(y / 10) * 10).cast("string"), F.lit("s"))
    elif kind == "five_years":
        label = F.concat((F.floor(y / 5) * 5).cast("string"), F.lit("-"), (F.floor(y / 5) * 5 + 4).cast("string"))
    else:
        raise ValueError(kind)
    return F.coalesce(label, F.lit("Unknown"))


def hours_between(a: str | Column, b: str | Column) -> Column:
    """Hours from a to b, two decimals; dates count from midnight, times without zone as UTC times of the session."""
    micros = lambda x: F.unix_micros((F.col(x) if isinstance(x, str) else x).cast("timestamp"))
    return F.floor((micros(b) - micros(a)) / 3.6e9 * 100 + 0.5) / 100.0


def entity(text: str | Column) -> Column:
    """True for entities of at least two characters that aren't only punctuation and space."""
    c = F.col(text) if isinstance(text, str) else text
    return (F.length(c) >= 2) & ~c.rlike(r"^[\p{Punct}\s]+$")


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product, folded in double precision in array order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def words(text: str | Column) -> Column:
    """Number of words between white space; NULL and blank texts have 0."""
    c = F.trim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.when(c == "", 0).otherwise(F.size(F.split(c, r"\s+")))
