"""Document fingerprints by Order MinHash: minimal occurrence-numbered k-mers in the order of the text, so that moves count as well as changes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import table

K, TUPLE, SIZE = 8, 2, 64
#: k-mers whose hashes are held for all components at once.
BLOCK = 2048
_MORE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class OrderMinHash:
    """Signatures of ``size`` components of 16 bits.

    For each component a hash orders all pairs (k-mer, its occurrence's number in the text); the k-mers of the ``tuple_`` least pairs, in the order in which they
    stand in the text, are hashed to the component. Two texts share a component with the probability that the same occurrences are least in both and stand in the
    same order, which falls with their edit distance. A text shorter than k is one k-mer, the empty text has none and components of zero.
    """

    def __init__(self, k: int = K, tuple_: int = TUPLE, size: int = SIZE):
        self.k, self.tuple, self.size = k, tuple_, size
        seeds = _mixed(np.arange(1, 2 * size + 1, dtype=np.uint64) * _MORE)
        self.mask = (seeds[:size] >> np.uint64(32)).astype(np.uint32)[:, None]
        self.factor = (seeds[size:] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        self.which, self.room = np.arange(size), np.empty((size, BLOCK), np.uint32)

    def kmers(self, codes: np.ndarray) -> np.ndarray:
        """A hash of each k-mer of code points: a polynomial, put together from those of runs that double in length."""
        k, n = min(self.k, len(codes)), len(codes)
        run, size, factor = codes.astype(np.uint64), 1, int(_MORE)
        out, have = None, 0
        while k:
            if k & 1:  # this run goes in front of what there is
                out = run if out is None else run[: n - have - size + 1] * np.uint64(pow(int(_MORE), have, 1 << 64)) + out[size:]
                have += size
            k >>= 1
            if k:
                run = run[:-size] * np.uint64(factor) + run[size:]
                size, factor = 2 * size, factor * factor % (1 << 64)
        return _mixed(out)

    @staticmethod
    def occurrences(h: np.ndarray) -> np.ndarray:
        """How many equal k-mers stand before each one. Those that agree in the upper bits (40 of them up to 16 million k-mers) are taken for equal."""
        n = len(h)
        low = np.uint64((1 << n.bit_length()) - 1)
        s = np.sort(h & ~low | np.arange(n, dtype=np.uint64))
        top = s & ~low
        at = np.arange(n)
        fresh = np.concatenate([[True], top[1:] != top[:-1]])
        if fresh.all():
            return np.zeros(n, np.uint64)
        out = np.empty(n, np.uint64)
        out[(s & low).astype(np.int64)] = at - np.maximum.accumulate(np.where(fresh, at, 0))
        return out

    def signature(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(self.size, np.uint16)
        h = self.kmers(codes)
        x = (_mixed(h + _MORE * self.occurrences(h)) >> np.uint64(32)).astype(np.uint32)
        value, place = np.zeros((self.size, 0), np.uint32), np.zeros((self.size, 0), np.int64)
        for s in range(0, len(x), BLOCK):
            some = x[None, s : s + BLOCK]
            v = np.bitwise_xor(some, self.mask, out=self.room[:, : some.shape[1]])
            v *= self.factor
            found = []
            for _ in range(min(self.tuple, v.shape[1])):  # of equal hashes the first
                i = v.argmin(axis=1)
                found.append((v[self.which, i], i))
                v[self.which, i] = 0xFFFFFFFF
            value = np.concatenate([value, *[a[:, None] for a, _ in found]], axis=1)
            place = np.concatenate([place, *[i[:, None] + s for _, i in found]], axis=1)
            if value.shape[1] > self.tuple:
                least = np.argsort(value, axis=1, kind="stable")[:, : self.tuple]
                value, place = np.take_along_axis(value, least, axis=1), np.take_along_axis(place, least, axis=1)
        place.sort(axis=1)
        out = np.full(self.size, place.shape[1], np.uint64)
        for at in place.T:
            out = _mixed(out * _MORE + h[at])
        return (out >> np.uint64(48)).astype(np.uint16)

    def of(self, text: str) -> np.ndarray:
        return self.signature(np.frombuffer(text.encode("utf-32-le"), "<u4"))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of components that are equal."""
    return float(np.count_nonzero(a == b)) / len(a)


def hex_of(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, scheme: OrderMinHash | None = None) -> DataFrame:
    """(doc_id, n_chars, fingerprint): four hex digits for each component. Null and empty texts have zeros; rows are independent of each other."""
    scheme = scheme or OrderMinHash()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            prints = pa.array([hex_of(scheme.of(t)) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), prints], names=["doc_id", "n_chars", "fingerprint"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def similarity(a: Column, b: Column) -> Column:
    """The likeness of two columns of fingerprints, in the JVM; null where either is null or they differ in length."""
    parts = lambda c: F.regexp_extract_all(c, F.lit("(....)"), F.lit(1))
    same = F.size(F.filter(F.zip_with(parts(a), parts(b), lambda x, y: x == y), lambda x: x))
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), same * 4.0 / F.length(a))


_CHAIN = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(kind, doc_id, text) in ``parts`` partitions, each a range of doc_id from the largest to the smallest (kind 0), behind it the document that follows the range (kind 1).

    Behind the last range follows the first document. Rows without doc_id are dealt by their text (kind 2). Bounds are looked for in the column doc_id alone; the driver
    holds two numbers for each partition.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.where("doc_id IS NOT NULL").select("doc_id")
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts).alias("c")).first().c or [])) if parts > 1 else []
    literal = lambda values: F.from_json(F.lit(json.dumps(values)), "array<long>")  # noqa: E731  one constant, whatever its length
    part = F.size(F.filter(literal(cuts), lambda c: c < F.col("doc_id")))
    tops = {r.p: r.top for r in ids.groupBy(part.alias("p")).agg(F.max("doc_id").alias("top")).collect()}  # a row a partition
    full = sorted(tops)
    after = dict(zip(full, [*full[1:], full[0]], strict=True)) if full else {}  # the range of which the largest document of a range comes behind
    top_of = literal([tops.get(p) for p in range(len(cuts) + 1)])
    to = literal([after.get(p) for p in range(len(cuts) + 1)])
    p = F.col("p").cast("int")
    place = lambda at, kind: F.struct(at.cast("int").alias("at"), F.lit(kind).alias("kind"))
    places = (
        F.when(F.col("doc_id").isNull(), F.array(place(F.pmod(F.xxhash64("text"), F.lit(parts)), 2)))
        .when(F.get(top_of, p) == F.col("doc_id"), F.array(place(p, 0), place(F.get(to, p), 1)))
        .otherwise(F.array(place(p, 0)))
    )
    dealt = rows.withColumn("p", part).select("doc_id", "text", F.explode(places).alias("x")).select(F.col("x.at").alias("at"), F.col("x.kind").alias("kind"), "doc_id", "text")
    return dealt.repartitionById(parts, "at").sortWithinPartitions("kind", F.desc("doc_id"), "text").select("kind", "doc_id", "text")


def edited_likeness(docs: DataFrame, scheme: OrderMinHash | None = None, share: int = 3, parts: int | None = None) -> DataFrame:
    """Each document with its fingerprint, its edited text's and its next document's: (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next).

    Documents follow each other by descending doc_id, of equal ids by text, and behind the last comes the first. The edited text has its last n_chars // share code points replaced
    by the first as many, or all, of the next document. Texts are dealt once, by ranges of doc_id; each task reads its range in order and holds two
    texts. Null texts are empty; rows that repeat doc_id and text are one document, and each gets its row; a row without doc_id has no next document: its edited
    text is its own, near_edited 1 and near_next null. An empty table gives no rows; other columns are not read.
    """
    scheme = scheme or OrderMinHash()
    spark = ship(docs.sparkSession)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def result(me: tuple, other: tuple) -> tuple:
        doc_id, text, own = me
        cut = len(text) // share
        edited = text if doc_id is None else text[: len(text) - cut] + other[1][:cut]
        changed = scheme.of(edited) if edited != text else own
        near = None if doc_id is None else likeness(own, other[2])
        return doc_id, len(text), edited, hex_of(own), hex_of(changed), likeness(own, changed), near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, waiting, times = 0, None, 0

        def batch() -> pa.RecordBatch:
            nonlocal out, held
            cols = zip(*out, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.large_string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = [x.split()[0] for x in _CHAIN.split(", ")]
            rows = pa.RecordBatch.from_arrays([pa.array(c, k).cast(pa.string() if k == pa.large_string() else k) for c, k in zip(cols, kinds, strict=True)], names=names)
            out, held = [], 0
            return rows

        def ended(other: tuple) -> Iterator[pa.RecordBatch]:
            nonlocal held
            row = result(waiting, other)
            for _ in range(times):
                out.append(row)
                held += len(row[2]) + 1024
                if held >= 1 << 23:
                    yield batch()

        for b in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            for kind, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("kind", "doc_id", "text")), strict=True):
                if waiting and kind == 0 and waiting[:2] == (doc_id, text):
                    times += 1
                    continue
                if kind and not waiting and kind == 1:
                    continue  # others with the id of the document that follows
                me = (doc_id, text, scheme.of(text))
                if waiting:
                    yield from ended(me)
                    waiting, times = None, 0
                if kind == 0:
                    waiting, times = me, 1
                elif kind == 2:
                    waiting, times = me, 1
                    yield from ended(me)
                    waiting, times = None, 0
        if out:
            yield batch()

    return with_next(docs, parts).mapInArrow(run, _CHAIN)


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts leave as their hashes."""
    found = edited_likeness(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
