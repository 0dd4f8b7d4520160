"""Filter interaction audit: what each filter removes alone, behind others and on average over all orders; duplicates are found by partition refinement."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import binary, cut, spread_join, table, written

#: Bytes at which the blocks of a text begin; the last block goes to its end.
EDGES = (0, 64, 1024, 16384)
KEYS = [f"c{k}" for k in range(len(EDGES) + 1)]
LETTERS = "ABCDE"
_UPPER, _SIGNS = bytes(range(65, 91)), b"#$%&*|"
_LONG = 1 << 23


def words(text: bytes) -> tuple[int, int]:
    """(words, different words): runs of bytes without space and \\t to \\r. Very long texts are split piece by piece."""
    if len(text) <= _LONG:
        w = text.split()
        return len(w), len(set(w))
    n, seen, at = 0, set(), 0
    while at < len(text):
        end = min(at + _LONG, len(text))
        while end < len(text) and text[end : end + 1].strip():
            end += 1
        w = text[at:end].split()
        n, at = n + len(w), end
        seen.update(w)
    return n, len(seen)


def text_mask(text: bytes, chars: int) -> int:
    """The conditions A to D that a text meets, as bits 1 to 8."""
    n, different = words(text)
    upper = len(text) - len(text.translate(None, _UPPER))
    signs = len(text) != len(text.translate(None, _SIGNS))
    return (n < 100) + 2 * (100 * different < 80 * n) + 4 * (100 * upper > 10 * chars) + 8 * signs


def classes(text: bytes, chars: int) -> list[int]:
    """Keys of ever finer classes: by length in code points, then by one block's hash after the other. Equal texts have equal keys throughout."""
    out = [xxhash.xxh64_intdigest(chars.to_bytes(8, "little"))]
    for a, z in zip(EDGES, [*EDGES[1:], None], strict=True):
        out.append(xxhash.xxh64_intdigest(text[a:z], out[-1]))
    return out


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, c0, c1, ...) for each row: the language (null as empty), the conditions A to D, and the keys of classes. Null texts are empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, chars = binary(b, "text"), pc.utf8_length(b.column("text")).to_pylist()
            mask = pa.array([text_mask(t, n) for t, n in zip(texts, chars, strict=True)], pa.int32())
            keys = _signed([k for t, n in zip(texts, chars, strict=True) for k in classes(t, n)]).reshape(-1, len(KEYS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), mask, *[pa.array(keys[:, i]) for i in range(len(KEYS))]], names=["doc_id", "part", "mask", *KEYS])

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, mask int, " + ", ".join(f"{c} long" for c in KEYS))


def refined(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows whose class still has another member when it has been split by each of the keys in turn; those alone in theirs are dropped at each step.

    Steps see narrow rows only. A class with very many rows is never one task's: its size is a partial count, and its rows stay where they are.
    """
    total = rows.count()
    for key in keys:
        sizes = rows.groupBy(key).count().where("count > 1")
        rows = cut(spread_join(rows, sizes, key, total, one_task=0, how="inner"))
    return rows


def bitmap(keys: DataFrame, most_bits: int = 1 << 28) -> np.ndarray:
    """Bits of the places of a key column's values: 16 for each different value, rounded up to a power of two, and ``most_bits`` (32 MB) at most.

    It only keeps texts from travelling that are alone in their class. With more values than fit, more travel, and the result is the same.
    """
    n = keys.distinct().count()
    bits = min(most_bits, max(1 << 15, 1 << (16 * max(n, 1)).bit_length()))
    at = F.pmod(F.col(keys.columns[0]), F.lit(bits)) + 1  # Spark's buckets and positions begin at one
    rows = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for bucket, held in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(held, np.uint8)
    return out


def firsts(docs: DataFrame, survivors: DataFrame) -> DataFrame:
    """(key, first): the smallest doc_id of each different text among those that survive, by comparing whole texts; the other texts don't travel."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(bitmap(survivors.select(KEYS[-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        n = 8 * len(held)
        for b in batches:
            texts, chars = binary(b, "text"), pc.utf8_length(b.column("text")).to_pylist()
            keys = _signed([classes(t, n_)[-1] for t, n_ in zip(texts, chars, strict=True)])
            at = keys % n
            take = pa.array(np.flatnonzero(held[at >> 3] >> (at & 7).astype(np.uint8) & 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys).take(take), b.column("doc_id").take(take), b.column("text").take(take)], names=["key", "doc_id", "text"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "key long, doc_id long, text string").groupBy("key", "text").agg(F.min("doc_id").alias("first")).select("key", "first")


def duplicates(docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Rows of features() whose text is that of a row with a smaller doc_id, of whatever language.

    Texts are split by length, then by the hashes of successive blocks, those alone being dropped at each step; what is left is compared by its whole texts,
    and all but the smallest id of each text are duplicates. Rows that repeat a doc_id with one text have no smaller one; a row without doc_id is no
    duplicate and makes none.
    """
    survivors = refined(features(docs) if rows is None else rows)
    same = (survivors[KEYS[-1]] == F.col("key")) & (survivors["doc_id"] == F.col("first"))
    return survivors.where("doc_id IS NOT NULL").join(firsts(docs, survivors), same, "left_anti")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by language and failed conditions (A to E are bits 1 to 16), and how many of them a label calls good or toxic.

    Of several labels of a document one is enough. Only counts by language and mask are gathered.
    """
    rows = written(features(docs))
    again = duplicates(docs, rows).select("doc_id", "part", "mask")
    moved = again.select("doc_id", "part", "mask", F.lit(-1).alias("n")).unionByName(again.select("doc_id", "part", (F.col("mask") + 16).alias("mask"), F.lit(1).alias("n")))
    signed = rows.select("doc_id", "part", "mask", F.lit(1).alias("n")).unionByName(cut(moved))
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c)
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(yes("quality"), yes("toxic")).where("quality + toxic > 0")
    counted = signed.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    of = signed.join(marked, "doc_id").groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    return counted.unionByName(of).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row per part, order of the filters and step, from mask_counts()."""
    steps = [
        {"filter_order": "".join(order), "step": k + 1, "bit": 1 << letters.index(f), "before": sum(1 << letters.index(x) for x in order[:k])} for order in permutations(letters) for k, f in enumerate(order)
    ]
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # as many as masks
    each = by_part.select("part", "m", F.inline(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")))
    has = lambda m, bits: m["mask"].bitwiseAND(bits) != 0

    def total(which, column: str = "n", times=lambda m: 1):
        return F.aggregate(F.filter("m", which), F.lit(0).cast("long"), lambda s, m: s + m[column] * times(m))

    bit, before = F.col("bit"), F.col("before")
    removed = lambda m: has(m, bit) & ~has(m, before)
    orders = len(steps) // len(letters)
    return each.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: ~has(m, bit) & ~has(m, before)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: has(m, bit) & has(m, before)).alias("redundant"),
        total(lambda m: m["mask"] == bit).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        # of the filters that a document fails, each comes first in as many orders
        total(lambda m: has(m, bit), times=lambda m: (F.lit(orders) / F.bit_count(m["mask"])).cast("long")).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty table gives no rows; columns other than doc_id, text, lang and the labels' doc_id, quality and toxic are not read."""
    return interactions(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
