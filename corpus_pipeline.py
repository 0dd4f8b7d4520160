"""A training-data pipeline of five stages over ``documents``: each takes what the one before kept, and its decisions take effect.

Each stage returns the columns of ``documents`` (other columns of its input are dropped), the last one the pieces of sequences.
An empty table gives no rows, texts have any length, and rows that repeat (the same doc_id and text) stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table, written
from corpusloom.llm.decontaminate import clean_documents
from corpusloom.llm.packing import packed
from corpusloom.llm.quality import quality
from corpusloom.llm.secrets import merged, redact_runs, secrets
from corpusloom.llm.simhash import near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null texts, empty ones and those without words go; a null doc_id is kept as it is."""
    return quality(docs.select(*COLUMNS), filtering=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id, or, where none has an id, with the smallest hash of its text.

    Of equal ids with different texts that with the smallest hash stays. Null and empty texts are copies of each other.
    """
    found = near_duplicates(docs).where("text_hash <> keeper OR NOT (doc_id <=> component_id)")
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("gone_hash"))
    return docs.select(*COLUMNS).join(gone, same, "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs: one that holds a passage goes whole, however long it is. Null and empty texts hold none."""
    return clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret, of whatever kind; n_chars follows the text where it changed. Null texts stay null.

    Overlapping and touching secrets have one mark. Rows that repeat doc_id and text are marked alike; a text of any length, with any number of secrets, takes time in proportion to its length.
    """
    found = merged(secrets(docs).where(F.size("spans") > 0).select("doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"]), "doc_id", "text_hash")
    rows = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["text_hash"] == found["text_hash"])
    marked = rows.join(found, same, "left").select(*(rows[c] for c in COLUMNS), found["runs"])
    text = F.when(F.col("runs").isNotNull(), redact_runs(F.col("text"), F.col("runs"))).otherwise(F.col("text"))
    return marked.select("doc_id", text.alias("text"), "lang", "source", "n_chars", F.col("runs").isNotNull().alias("m")).select(
        "doc_id", "text", "lang", "source", F.when(F.col("m"), F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids; a null text has its end id only. Rows that repeat are packed each, and how ties fall is left to how rows are dealt."""
    return packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]
#: Fingerprints, fitted weights and packing are beyond SQL; tests compare run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
