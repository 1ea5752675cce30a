"""Articles arriving as a stream: deduplicated within a watermark, cut to units, labelled, written exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import sentences, two_sentence_units
from corpusloom.operators.annotate import LEXICON, by_lexicon


def unit_stream(articles: DataFrame, key: str, text: str, ts: str, late: str = "7 days") -> DataFrame:
    """Two-sentence units of a stream of articles, labelled by the lexicon.

    An article delivered again within ``late`` of the newest one is dropped;
    older deliveries are late and dropped, too.  Works on a batch as well (then copies of
    a key are dropped whenever they came).  NULL keys and texts are left out.
    """
    usable = articles.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).withColumn("_ts", F.col(ts).cast("timestamp"))
    once = usable.withWatermark("_ts", late).dropDuplicatesWithinWatermark([key]) if articles.isStreaming else usable.dropDuplicates([key])
    units = once.select(key, "_ts", F.posexplode(two_sentence_units(sentences(text))).alias("_i", "unit"))
    return by_lexicon(units.select(key, (F.col("_i") + 1).alias("sentence_id"), "unit", F.col("_ts").alias(ts)), "unit", LEXICON)


def windowed_counts(units: DataFrame, ts: str, code: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Positive units of a label per time window; a window is final once the watermark has passed it."""
    t = units.withWatermark(ts, late) if units.isStreaming else units
    return t.groupBy(F.window(ts, width).alias("w")).agg(F.count_if(F.col(code) == 1).alias("n"), F.count("*").alias("n_units")).select(F.col("w.start").alias("start"), "n", "n_units")


def written(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts writing: Parquet files, or a function per micro-batch; the checkpoint makes restarts resume where they stopped."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return w.foreachBatch(each).start() if each else w.format("parquet").outputMode("append").start(path)
