"""Incremental use of the batch operators on streams; an extra, as the operators themselves are batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import normalize_text, words


def arriving_words(stream: DataFrame, at: str, text: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, documents, words) per window of arrival time, rows up to `late` behind the newest counted."""
    counted = stream.select(F.col(at).alias("at"), F.size(words(normalize_text(F.coalesce(F.col(text), F.lit(""))))).alias("n"))
    grouped = counted.withWatermark("at", late).groupBy(F.window("at", window).alias("w"))
    return grouped.agg(F.count("*").alias("documents"), F.sum("n").alias("words")).select(F.col("w.start").alias("start"), "documents", "words")


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run a batch operator on every micro-batch and append its rows; a batch that is retried replaces its own folder."""

    def run(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
