"""Weighted counts over units: words, lines, symbols and adjacent pairs, and the corpus fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_freq(lines: DataFrame) -> DataFrame:
    """(unit, freq) of the words between single spaces; empty ones are no words."""
    return lines.select(F.explode(F.split("text", " ", -1)).alias("unit")).where("unit <> ''").groupBy("unit").agg(F.count("*").alias("freq"))


def line_freq(lines: DataFrame) -> DataFrame:
    """(unit, freq) of whole lines that are not empty."""
    return lines.where("text <> ''").groupBy(F.col("text").alias("unit")).agg(F.count("*").alias("freq"))


def symbols_of(unit: str = "unit"):
    """A unit's characters, each a symbol."""
    return F.filter(F.split(unit, ""), lambda c: c != "")


def pair_counts(units: DataFrame) -> DataFrame:
    """(a, b, n) of overlapping adjacent symbols, weighted by frequency: three equal symbols hold the pair twice.

    Units have a string column unit of one character for each symbol; the work is proportional to distinct units.
    """
    s = symbols_of()
    pairs = F.zip_with(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return units.select("freq", F.inline(pairs)).groupBy("a", "b").agg(F.sum("freq").alias("n"))


def symbol_counts(units: DataFrame) -> DataFrame:
    return units.select("freq", F.explode(symbols_of()).alias("symbol")).groupBy("symbol").agg(F.sum("freq").alias("n"))


def fingerprint(units: DataFrame) -> DataFrame:
    """One row: units, total frequency and total symbols joined by colons, and a hash of the content, which the first three do not see."""
    return units.agg(
        F.concat_ws(":", F.count("*"), F.coalesce(F.sum("freq"), F.lit(0)), F.coalesce(F.sum(F.length("unit") * F.col("freq")), F.lit(0))).alias("fingerprint"),
        F.bit_xor(F.xxhash64("unit", "freq")).alias("content"),
    )
