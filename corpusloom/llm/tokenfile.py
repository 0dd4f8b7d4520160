"""Token files: id arrays compressed one by one with a shared zstandard dictionary, in blocks that carry their offsets.

A token file is a folder that Spark writes and reads (so in any store that Spark knows):

* ``dictionary``: one row (hash, width, end_id, dictionary). hash is the SHA-256 of the dictionary's bytes, "" without one.
* ``blocks``: rows in ascending doc_id order. part, block: place in the order; first_doc, last_doc: for skipping by
  Parquet statistics; before: ids of the part in front of the block; n_tokens; dict_hash; doc_ids, sizes (ids) and ends
  (byte offset behind the frame in blob) by document; blob: the zstandard frames one after another.

A frame holds the ids of one document as little-endian unsigned integers of ``width`` bytes, so a short document is
read by its block's offsets alone, without its neighbours.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import discarded, scratch, table, written
from .tokens import encoder, vocabulary

#: Ids of a document that the dictionary may be trained on.
SAMPLE_IDS = 4096
BLOCK = "part long, block long, first_doc long, last_doc long, before long, n_tokens long, dict_hash string, doc_ids array<long>, sizes array<long>, ends array<long>, blob binary"


def _narrow(ids: bytes, width: int) -> bytes:
    if width == 4:
        return ids
    a = np.frombuffer(ids, "<u4")
    if len(a) and a.max() >> 16:
        raise ValueError(f"id {a.max()} needs a width of 4 bytes")
    return a.astype("<u2").tobytes()


def _wide(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def train_dictionary(samples: list[bytes], size: int = 64 * 1024) -> bytes:
    """A zstandard dictionary; empty if there is too little to train on."""
    samples = [s for s in samples if len(s) >= 8]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 20)), samples).as_bytes() if len(samples) >= 20 else b""
    except zstandard.ZstdError:
        return b""


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, width: int = 2, sample_docs: int = 1000, block_bytes: int = 1 << 20, level: int = 1) -> str:
    """Encodes doc_id, text into a token file in ``folder`` and returns the folder.

    The dictionary is trained on the first SAMPLE_IDS ids of about sample_docs documents, drawn by a hash of doc_id and text (twice as many at most;
    the bound on what the driver sees). An id that width bytes cannot hold is refused. Null and empty texts have their end id only; rows with equal doc_id all stay, in the order of their
    checksums; a null doc_id comes first; an empty table gives a folder without blocks; other columns are not read.
    Each text is encoded once: frames are written, then dealt by ranges of doc_id, sorted and put together in blocks.
    """
    spark = ship(docs.sparkSession)
    path, end = path or vocabulary(), end_id.to_bytes(4, "little")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    share = min(1.0, sample_docs / max(1, docs.count()))

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = encoder(path)
        for b in batches:
            ids = [_narrow(x + end, width)[: SAMPLE_IDS * width] for x in read.encode_all(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(ids, pa.binary())], names=["key", "ids"])

    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    drawn = docs.select(key.alias("key"), "text").where(F.pmod("key", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    sample = drawn.mapInArrow(serialized, "key long, ids binary").dropDuplicates(["key"]).orderBy("key").limit(2 * sample_docs)
    trained = train_dictionary([bytes(r.ids) for r in sample.collect()])
    digest = hashlib.sha256(trained).hexdigest() if trained else ""
    spark.createDataFrame([(digest, width, end_id, bytearray(trained))], "hash string, width int, end_id int, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, shared = encoder(path), zstandard.ZstdCompressionDict(trained) if trained else None
        if shared:
            shared.precompute_compress(level=level)  # else each document digests it again
        press = zstandard.ZstdCompressor(level=level, dict_data=shared)
        for b in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            ids = [x + end for x in read.encode_all(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([press.compress(_narrow(x, width)) for x in ids], pa.binary())],
                names=["doc_id", "crc", "size", "frame"],
            )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, count = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal before, count, rows, held
            ids, sizes, parts = zip(*rows, strict=True)
            n = sum(sizes)
            known = [i for i in ids if i is not None]
            row = [part, count, min(known, default=None), max(known, default=None), before, n, digest, list(ids), list(sizes), np.cumsum([len(x) for x in parts]).tolist(), b"".join(parts)]
            kinds = [*[pa.int64()] * 6, pa.string(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            before, count, rows, held = before + n, count + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCK.split(", ")])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "size", "frame")), strict=True):
                rows.append(row)
                held += len(row[2])
                if held >= block_bytes:
                    yield block()
        if rows:
            yield block()

    done = written(docs.mapInArrow(frames, "doc_id long, crc long, size long, frame binary"))
    dealt = done.repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc")
    dealt.mapInArrow(blocks, BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks")
    return folder


def read_tokens(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids are the bytes of little-endian unsigned 32-bit integers; start counts the ids of all documents before it.

    With doc_ids only the blocks that may hold them are read, and of these only the frames asked for are decompressed.
    A block written with another dictionary is refused. The driver sees one row for each part.
    """
    ship(spark)
    digest, width, _, trained = spark.read.parquet(f"{folder}/dictionary").first()
    trained = bytes(trained)
    if digest != (hashlib.sha256(trained).hexdigest() if trained else ""):
        raise ValueError("the dictionary is not the one its hash names")
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    totals = sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_tokens")).collect())
    start = dict(zip([p for p, _ in totals], np.cumsum([0, *(n for _, n in totals)]).tolist(), strict=False))
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        blocks = blocks.where(F.exists(F.array(*map(F.lit, sorted(wanted))), lambda i: (i >= F.col("first_doc")) & (i <= F.col("last_doc")))) if wanted else blocks.limit(0)
        if wanted:
            blocks = blocks.where((F.col("last_doc") >= min(wanted)) & (F.col("first_doc") <= max(wanted)))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        for b in batches:
            for r in b.to_pylist():
                if r["dict_hash"] != digest:
                    raise ValueError(f"block {r['part']}/{r['block']} needs dictionary {r['dict_hash']}, not {digest}")
                at, out, a = start[r["part"]] + r["before"], [], 0
                for i, n, e in zip(r["doc_ids"], r["sizes"], r["ends"], strict=True):
                    if wanted is None or i in wanted:
                        out.append((i, at, n, _wide(unpress.decompress(r["blob"][a:e], max_output_size=n * width), width)))
                    at, a = at + n, e
                if out:
                    cols = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(ids, "doc_id long, start long, n_tokens long, ids binary")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = discarded(spark, write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens-")))
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
