"""Marker coverage and expansion of normalised text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalize import markers, normalize

#: Fixed value: markers with fewer occurrences are rare.
RARE = 20


def normalized_lines(lines: DataFrame) -> DataFrame:
    """Adds ``processed``, the normalised text of each line."""
    return lines.withColumn("processed", normalize(F.col("text")))


def expansion(lines: DataFrame) -> DataFrame:
    """By language: raw and processed characters, the factor between them, unique markers and the share of characters in markers."""
    one = normalized_lines(lines).select("lang", F.length("text").alias("raw"), F.length("processed").alias("n"), markers(F.col("processed")).alias("m"))
    none = F.struct(F.lit(None).cast("string").alias("marker"), F.col("raw").alias("raw"), F.col("n").alias("n"))
    parts = F.concat(F.array(none), F.transform("m", lambda x: F.struct(x.alias("marker"), F.lit(0).alias("raw"), F.lit(0).alias("n"))))
    # by marker first, so that no language's markers meet in one buffer
    by = one.select("lang", F.inline(parts)).groupBy("lang", "marker").agg(F.sum("raw").alias("raw"), F.sum("n").alias("n"), F.count("*").alias("times"))
    in_markers = F.coalesce(F.sum(F.when(F.col("marker").isNotNull(), F.length("marker") * F.col("times"))), F.lit(0))
    total = by.groupBy("lang").agg(F.sum("raw").alias("raw_chars"), F.sum("n").alias("processed_chars"), in_markers.alias("marker_chars"), F.count("marker").alias("unique_markers"))
    return total.select(
        "lang",
        "raw_chars",
        "processed_chars",
        "unique_markers",
        (F.col("processed_chars") / F.greatest("raw_chars", F.lit(1))).alias("expansion_factor"),
        (F.col("marker_chars") / F.greatest("processed_chars", F.lit(1))).alias("marker_char_fraction"),
    )


def marker_counts(lines: DataFrame) -> DataFrame:
    """(lang, marker, n, first_doc, first_line, first_pos): how often each marker occurs and where first."""
    one = normalized_lines(lines).select("lang", "doc_id", "line_no", F.posexplode(markers(F.col("processed"))).alias("pos", "marker"))
    return one.groupBy("lang", "marker").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line_no", "pos")).alias("first"))


def top_markers(lines: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent markers of each language; of equal ones those that occur first."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "first")
    return marker_counts(lines).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("lang", "rank", "marker", "n")


def rare_markers(lines: DataFrame, least: int = RARE) -> DataFrame:
    """Markers with fewer than ``least`` occurrences in a language, the rarest first."""
    order = Window.partitionBy("lang").orderBy("n", "first")
    return marker_counts(lines).where(F.col("n") < least).withColumn("rank", F.row_number().over(order)).select("lang", "rank", "marker", "n")
