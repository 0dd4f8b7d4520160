"""Text as rows: files, directories, byte ranges and lines, always with a language and an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; bytes that are no UTF-8 become U+FFFD."""
    return spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def head_bytes(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(path, head): the first n bytes of each file a path or pattern names, in any store Hadoop reads (http and https among them).

    A ranged fetch: each file is opened by the driver and no more than n bytes are read, so n is what bounds it.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    found = [place] if place.toUri().getScheme() in ("http", "https") else [x.getPath() for x in fs.globStatus(place) or []]
    rows = []
    for p in found:
        stream = fs.open(p)
        try:
            rows.append((p.toString(), bytearray(stream.readNBytes(n))))
        finally:
            stream.close()
    return spark.createDataFrame(rows, "path string, head binary")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, text) of files of any size, read by lines and by splits: (block, at) is a line's order within its file.

    Lines end at line feeds, carriage returns or both; bytes that are no UTF-8 become U+FFFD.
    """
    read = spark.read.text(path)
    return read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.make_valid_utf8(F.col("value")).alias("text")
    )


def read_dir_lines(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """(lang, block, at, text): file_lines() of a folder's files that end in ``suffix``, by language."""
    found = file_lines(spark, f"{folder}/*{suffix}")
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    return found.select(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("lang"), "block", "at", "text")


def trimmed_to_line(text: Column) -> Column:
    """A cut-off sample without its last, incomplete line; as it is if no line end lies behind the first character."""
    last = F.length(text) - F.locate("\n", F.reverse(text)) + 1
    return F.when(F.locate("\n", F.reverse(text)) == 0, text).when(last > 1, F.substring(text, F.lit(1), last - 1)).otherwise(text)


def sample_size(sample: Column) -> Column:
    """Bytes and lines of a sample (a trailing piece counts as a line)."""
    return F.struct(F.octet_length(sample).cast("long").alias("bytes"), (F.regexp_count(sample, F.lit("\n")) + 1).cast("long").alias("lines"))


def read_dir(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """(lang, text) of the *.txt files of a folder: lang is the file's name without ``suffix``."""
    name = F.element_at(F.split("path", "/"), -1)
    found = read_whole(spark, f"{folder}/*.txt")
    return found.where(name.endswith(suffix)).select(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("lang"), "text")


def lines(texts: DataFrame, keep: str = "nonempty") -> DataFrame:
    """(lang, doc_id, line_no, text) of texts (lang, doc_id, text), split at line feeds; line_no counts all lines from 0.

    keep: "all", "nonempty" (white space alone stays) or "nonblank". A null text has no lines.
    """
    out = texts.select("lang", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    return out.where({"all": "true", "nonempty": "text <> ''", "nonblank": r"text RLIKE '(?U)\\S'"}[keep])


def document_lines(spark: SparkSession, sf_dir: str, keep: str = "nonempty") -> DataFrame:
    return lines(table(spark, sf_dir, "documents").select("lang", "doc_id", "text"), keep)


#: Bytes to sample by language.
SAMPLE_JOBS = (
    ("amharic", 5_000_000),
    ("hausa", 5_000_000),
    ("somali", 5_000_000),
    ("swahili", 5_000_000),
    ("yoruba", 5_000_000),
    ("igbo", 5_000_000),
    ("kinyarwanda", 5_000_000),
    ("xhosa", 45_000_000),
    ("zulu", 8_000_000),
)


def sample_jobs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SAMPLE_JOBS), "lang string, n_bytes long")


def source_registry(languages: DataFrame, root: str) -> DataFrame:
    """(name, path): where the text of each language of a registry is expected."""
    return languages.select("name", F.concat(F.lit(f"{root}/"), slug(F.col("name")), F.lit(".txt")).alias("path"))


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def coverage_slug(name: Column) -> Column:
    """The first word of a name, without what stands in parentheses."""
    return F.split_part(F.split_part(F.lower(name), F.lit(" "), F.lit(1)), F.lit("("), F.lit(1))


def sourced(languages: DataFrame, root: str) -> DataFrame:
    """source_registry(), which fails on a language whose file is not there."""
    spark, found = languages.sparkSession, source_registry(languages, root)
    conf = spark._jsc.hadoopConfiguration()
    for r in found.collect():  # a registry has one row for each language
        place = spark._jvm.org.apache.hadoop.fs.Path(r.path)
        if not place.getFileSystem(conf).exists(place):
            raise FileNotFoundError(f"{r.name}: {r.path}")
    return found
