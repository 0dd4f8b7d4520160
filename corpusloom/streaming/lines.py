"""The line filters and the normaliser are stateless columns, so they run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import normalize
from ..functions.scripts import contamination


def stream_lines(spark: SparkSession, folder: str, lang: str) -> DataFrame:
    """Lines of text files as they arrive in a folder."""
    return spark.readStream.text(folder).select(F.lit(lang).alias("lang"), F.col("value").alias("text"))


def cleaned(lines: DataFrame, profile: str = "latin", least: int = 3) -> DataFrame:
    """Lines without foreign script, normalised; what is empty then is dropped."""
    kept = lines.where(contamination(F.col("text"), profile, least).isNull())
    return kept.withColumn("text", normalize(F.col("text"))).where("text <> ''")


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values by type in tumbling windows; on a stream, what comes later than ``late`` is left out."""
    counted = events.withWatermark("ts", late) if events.isStreaming else events
    return counted.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")
