"""Incremental counts: n-gram models and sound frequencies over a stream of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ngrams import context_counts, segments


def stream_context_counts(words: DataFrame, column: str = "form", pre: int = 1, post: int = 0) -> DataFrame:
    """Counts of contexts and states over a stream of words: write it in update or complete mode."""
    return context_counts(words, segments(F.col(column)), pre, post)


def stream_type_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each kind in tumbling windows, late ones up to a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
