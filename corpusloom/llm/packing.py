"""Packing into fixed windows: repeat counts of length combinations by non-negative least squares, and a greedy rest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import table
from .tokens import encoder, vocabulary

RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache
def combinations_of(bins: int, depth: int) -> np.ndarray:
    """Ways to fill a window of ``bins`` units with at most ``depth`` lengths of 1..bins units, as columns of counts by length."""
    found: list[tuple[int, ...]] = []

    def extend(parts: tuple[int, ...], left: int) -> None:
        if not left:
            found.append(parts)
        elif len(parts) < depth:
            for x in range(min(left, parts[-1] if parts else left), 0, -1):
                extend((*parts, x), left - x)

    extend((), bins)
    a = np.zeros((bins, len(found)))
    for k, parts in enumerate(found):
        for x in parts:
            a[x - 1, k] += 1
    return a


def nnls(a: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that makes |a x - y| least: the active-set method of Lawson and Hanson."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slope = a.T @ (y - a @ x)
    for _ in range(rounds):
        if free.all() or (slope[~free] <= 1e-9 * max(1.0, np.abs(y).max())).all():
            break
        free[np.argmax(np.where(free, -np.inf, slope))] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], y, rcond=None)[0]
            if not (bad := free & (s <= 0)).any():
                break
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x += step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
        x = s
        slope = a.T @ (y - a @ x)
    return x


def pack(lengths: np.ndarray, window: int = 2048, bins: int = 32, depth: int = 4) -> np.ndarray:
    """Pieces of documents of these lengths as rows (document, start, length, sequence, offset); sequences are numbered from 0.

    Whole windows are cut from long documents. The histogram of what remains, in units of window / bins rounded up, is
    matched by combinations that fill a window; each is used as often as least squares say, rounded down, as long as its
    lengths last. Rounding up leaves a gap at the end of each such sequence; the documents that no combination took, in
    the order of their length, are cut to fill these gaps and then further windows. The last tokens make sequences whose
    lengths are powers of two, so that nothing is padded. No tokens, no pieces.
    """
    out: list[tuple[int, int, int, int, int]] = []
    unit = -(-window // bins)
    full = lengths // window
    rest = lengths - full * window
    seq = 0
    for d in np.flatnonzero(full).tolist():
        for k in range(int(full[d])):
            out.append((d, k * window, window, seq, 0))
            seq += 1
    size = -(-rest // unit)
    by_size = [[] for _ in range(bins + 1)]
    for d in np.argsort(rest, kind="stable").tolist():
        by_size[size[d]].append(d)
    a = combinations_of(bins, depth)
    counts = np.array([len(b) for b in by_size[1:]], float)
    times = np.floor(nnls(a, counts) + 1e-6).astype(int) if counts.any() else np.zeros(a.shape[1], int)
    planned: list[list[int]] = []
    for k in np.argsort(-times, kind="stable")[: int((times > 0).sum())].tolist():
        parts = [(s + 1, int(n)) for s, n in enumerate(a[:, k]) if n]
        for _ in range(min(int(times[k]), *(len(by_size[s]) // n for s, n in parts))):
            planned.append([by_size[s].pop() for s, n in parts for _ in range(n)])
    loose = [d for b in reversed(by_size[1:]) for d in b]
    gaps = [window - int(rest[p].sum()) for p in map(np.array, planned)]
    have, need = int(rest[loose].sum()) if loose else 0, sum(gaps)
    while planned and have < need:  # the last sequences planned give what fills the others
        have += window - gaps[-1]
        need -= gaps.pop()
        loose += planned.pop()
    feed = [(d, int(full[d]) * window, int(rest[d])) for d in reversed(loose)]

    def fill(seq: int, at: int, room: int) -> None:
        while room:
            d, s, n = feed.pop()
            take = min(n, room)
            out.append((d, s, take, seq, at))
            at, room = at + take, room - take
            if take < n:
                feed.append((d, s + take, n - take))

    for p, gap in zip(planned, gaps, strict=True):
        at = 0
        for d in p:
            out.append((d, int(full[d]) * window, int(rest[d]), seq, at))
            at += int(rest[d])
        fill(seq, at, gap)
        seq += 1
    left = sum(n for _, _, n in feed)
    while left:
        n = min(window, 1 << (left.bit_length() - 1))
        fill(seq, 0, n)
        left -= n
        seq += 1
    return np.array(out, np.int64).reshape(-1, 5)


def packed(docs: DataFrame, path: str | None = None, end_id: int = 1, window: int = 2048, chunk_tokens: int = 4_000_000) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task packs what it reads by a plan of its own, so small partitions leave more of it to the greedy rest and to short last
    sequences: in chunks of some chunk_tokens ids (and what 256 documents more have) that are packed at once; the table needs no shuffle
    and memory is bounded by a chunk, the 2048 documents that are encoded at once and the longest documents. sequence_id is the partition's number times 2^40 and a
    count, so it is unique. A null or empty text has its end id only. Rows with equal doc_id are packed each by itself, a
    null doc_id stays null, other columns are not read, and an empty table gives no rows.
    """
    ship(docs.sparkSession)
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, end = encoder(path), end_id.to_bytes(4, "little")
        first = TaskContext.get().partitionId() << 40

        def rows(ids: list[int], held: list[bytes]) -> pa.RecordBatch:
            nonlocal first
            sizes = np.array([len(x) // 4 for x in held], np.int64)
            p = pack(sizes, window)
            crc = [zlib.crc32(memoryview(held[d])[4 * s : 4 * (s + n)]) for d, s, n in p[:, :3].tolist()]
            cols = [pa.array(ids, pa.int64()).take(pa.array(p[:, 0])), *map(pa.array, (p[:, 1], p[:, 2], np.array(crc, np.int64), sizes[p[:, 0]], first + p[:, 3], p[:, 4]))]
            first += int(p[:, 3].max()) + 1 if len(p) else 0
            return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in RESULT.split(", ")])

        ids, held, n = [], [], 0
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                names, found = part.column("doc_id").to_pylist(), [x + end for x in read.encode_all(part.column("text").to_pylist())]
                for j in range(0, len(found), 256):
                    ids += names[j : j + 256]
                    held += found[j : j + 256]
                    n += sum(map(len, found[j : j + 256])) // 4
                    if n >= chunk_tokens:
                        yield rows(ids, held)
                        ids, held, n = [], [], 0
        if held:
            yield rows(ids, held)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
