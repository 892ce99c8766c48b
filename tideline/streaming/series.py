"""An extension: term counts by bin kept up to date from a stream of documents. Late data is dropped by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import tokens


def streaming_bins(docs: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """start, term, n of a stream (ts timestamp, text): tumbling windows of a bin's width."""
    each = docs.withWatermark("ts", late).select("ts", F.explode(tokens(F.col("text"))).alias("term"))
    return each.groupBy(F.window("ts", width).alias("w"), "term").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "term", "n")


def streaming_events(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
