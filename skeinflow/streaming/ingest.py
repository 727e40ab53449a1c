"""Extension: corpus lines as a stream, and per-group deduplication with state.

Batch operators have no need of this; it feeds the same frames from folders that
keep growing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.jsonl import GROUP


def stream_groups(spark: SparkSession, root: str) -> DataFrame:
    """Groups of JSON lines of new files below a folder, as they come; lines that don't parse have a null group."""
    lines = spark.readStream.format("text").option("recursiveFileLookup", "true").load(root)
    return lines.select(F.from_json("value", GROUP).alias("group"), F.col("value").alias("json"))


def first_of_each(stream: DataFrame, keys: list[str], event_time: str, late: str) -> DataFrame:
    """The first row of each key within the watermark; state older than that is dropped."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, key: str, late: str, length: str) -> DataFrame:
    """key, window start, n of a stream with late rows up to ``late``."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, length), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")
