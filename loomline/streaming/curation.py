"""Structured Streaming forms of the curation steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import clean_text, key_without_marks
from loomline.operators.dedup import drop_reason


def cleaned_stream(stream: DataFrame) -> DataFrame:
    """Stateless: cleaned records and the reason for which a batch run would drop them."""
    return stream.withColumn("reason", drop_reason("question", "answer")).withColumn("question", clean_text("question")).withColumn("answer", clean_text("answer"))


def deduplicated_stream(stream: DataFrame, time_column: str, delay: str = "1 hour") -> DataFrame:
    """First record of every question key within the watermark; state is bounded by the delay."""
    keyed = stream.withColumn("dedup_key", F.md5(key_without_marks("question"))).withWatermark(time_column, delay)
    return keyed.dropDuplicatesWithinWatermark(["dedup_key"])


def windowed_counts(stream: DataFrame, time_column: str, key: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts per tumbling window and key; late data beyond the watermark is dropped."""
    return stream.withWatermark(time_column, delay).groupBy(F.window(time_column, width).alias("window"), key).agg(F.count("*").alias("records")).select(F.col("window.start").alias("window_start"), key, "records")
