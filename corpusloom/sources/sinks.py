"""Where results go: text by language, one combined corpus, JSON documents, and splits that are made once."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_corpus(lines: DataFrame, folder: str) -> None:
    """One folder of text by language; rows (lang, text, and an order) are in the order of the columns behind them, within files and from file to file by name."""
    order = [c for c in lines.columns if c not in ("lang", "text")]
    lines.repartitionByRange("lang", *order).sortWithinPartitions("lang", *order).select("lang", "text").write.mode("overwrite").partitionBy("lang").text(folder)


def write_combined(lines: DataFrame, folder: str, *order: str) -> None:
    """All lines as text, in the global order of some columns."""
    lines.orderBy(*order).select("text").write.mode("overwrite").text(folder)


def _remote(path: str):
    """The Hadoop file system and path of a name with a scheme, and None for a plain local name."""
    if "://" not in path:
        return None
    spark = SparkSession.getActiveSession()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place, spark._jvm


def atomic_json(path: str, value: object) -> None:
    """A JSON document that is either the old one or the new one, never half of it; for small artifacts of the driver.

    A path with a scheme may be in any store that Spark's session can write to.
    """
    text = json.dumps(value, ensure_ascii=False)
    if there := _remote(path):
        fs, place, jvm = there
        part = place.suffix(".tmp")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = SparkSession.getActiveSession().sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), fs.getConf()).rename(part, place, options)
        return
    part = Path(f"{path}.tmp")
    part.parent.mkdir(parents=True, exist_ok=True)
    part.write_text(text, encoding="utf-8")
    os.replace(part, path)


_MISSING = object()


def read_json(path: str, default: object = _MISSING):
    """A JSON document from a local path or any store that Spark's session reads; ``default``, if given, where there is none."""
    if there := _remote(path):
        fs, place, _ = there
        if not fs.exists(place) and default is not _MISSING:
            return default
        stream = fs.open(place)
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return json.loads(text)
    if not os.path.exists(path) and default is not _MISSING:
        return default
    return json.loads(Path(path).read_text(encoding="utf-8"))


def fingerprint_of(df: DataFrame) -> str:
    """Row count and an order-free hash of all columns."""
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("s")).first()
    return f"{row.n}:{(row.x or 0) & (2**64 - 1):016x}:{row.s or 0}"


def made_once(make, source: DataFrame, path: str) -> DataFrame:
    """``make(source)`` kept as Parquet under a name that holds the source's fingerprint: made for a source once, and again if the source is another."""
    spark = source.sparkSession
    place = f"{path}/{fingerprint_of(source).replace(':', '-')}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make(source).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
