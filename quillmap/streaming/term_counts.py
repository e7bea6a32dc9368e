"""Incremental term counts over a stream of records (an extension: the batch operators are the core).

State is one count per term; late records still count, as a count has no window. For windows, give
the event-time column and a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.network import term_array


def term_counts(stream: DataFrame, terms: Column) -> DataFrame:
    """term, count of a streaming (or batch) DataFrame; write it in update or complete mode."""
    return stream.select(F.explode(term_array(terms)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("count"))


def windowed_counts(stream: DataFrame, ts: str, terms: Column, window: str, delay: str) -> DataFrame:
    """window, term, count; records later than `delay` behind the newest are left out."""
    rows = stream.withWatermark(ts, delay).select(F.window(ts, window).alias("window"), F.explode(term_array(terms)).alias("term"))
    return rows.groupBy("window", "term").agg(F.count(F.lit(1)).alias("count")).select(F.col("window.start").alias("start"), "term", "count")
