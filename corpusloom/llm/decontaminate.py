"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, run once over each text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import binary, cut, table, written

#: Bytes that stand for themselves in a word: digits, lower-case letters (upper ones are lowered), all of UTF-8 beyond ASCII.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
RUNS = "array<struct<w:bigint,v:bigint,start:bigint,end:bigint>>"
SCANNED = f"doc_id long, text_key string, n_words long, items array<string>, runs {RUNS}"
_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("w", "v", "start", "end")]))
_MATCHERS: dict[str, "Matcher"] = {}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Block:
    """Items' words, ids, and the patterns of one automaton: what is broadcast, bounded by the caller."""

    def __init__(self, window: int):
        self.window, self.anchor = window, (window + 1) // 2
        self.words: list[list[bytes]] = []
        self.ids: list[str | None] = []
        self.bytes = 0

    def add(self, item_id: str | None, words: list[bytes]) -> None:
        self.words.append(words)
        self.ids.append(item_id)
        self.bytes += sum(map(len, words)) + len(words)

    def key(self) -> str:
        return hashlib.sha256(repr((self.window, self.words, self.ids)).encode()).hexdigest()


def blocks(benchmark: DataFrame, n: int, max_bytes: int) -> Iterator[Block]:
    """The benchmark's items in blocks of some max_bytes of words: one block unless the benchmark is larger. A longer item is cut into pieces that share n - 1 words, so that every window is in one of them."""
    block = Block(n)
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        w = words_of(bytes(row[1])) if row[1] is not None else []
        step = max(1, max_bytes // 8)
        for i in range(0, max(1, len(w) - n + 1) if w else 0, step):
            block.add(row[0], w[i : i + step + n - 1])
            if block.bytes >= max_bytes:
                yield block
                block = Block(n)
    if block.words:
        yield block


#: Items of one anchor from which on its windows are patterns themselves.
HOT = 32


def _pattern(words: list[bytes]) -> str:
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


class Matcher:
    """One Aho-Corasick automaton over all items.

    Every window holds one of the anchors of half its words that begin at multiples of that number in its item. So these
    are the patterns (a state for each byte of the benchmark, not for each byte of each window), and where one is met
    its neighbours are compared with those in the item: a run of a window's words or more is all windows. Windows whose
    anchor stands in more than HOT places are patterns themselves, as are items shorter than a window.
    """

    def __init__(self, block: Block):
        self.n, self.k, self.items, self.ids = block.window, block.anchor, block.words, block.ids
        at: dict[str, list[tuple[int, int]]] = {}
        whole: dict[str, tuple[int, set[str]]] = {}

        def window(i: int, s: int, e: int) -> None:
            words = self.items[i][s:e]
            found = whole.setdefault(_pattern(words), (len(words), set()))
            if self.ids[i] is not None:
                found[1].add(self.ids[i])

        for i, w in enumerate(self.items):
            if len(w) < self.n:
                window(i, 0, len(w))
            else:
                for p in range(0, len(w) - self.k + 1, self.k):
                    at.setdefault(_pattern(w[p : p + self.k]), []).append((i, p))
        for places in (v for v in at.values() if len(v) > HOT):
            for i, p in places:
                for s in range(max(0, p - self.n + self.k), min(p, len(self.items[i]) - self.n) + 1):
                    window(i, s, s + self.n)
        self.automaton = ahocorasick.Automaton()
        patterns: dict[str, list] = {}
        for p, places in at.items():
            if len(places) <= HOT:
                patterns.setdefault(p, [len(p), None, None])[1] = places
        for p, (n, ids) in whole.items():
            patterns.setdefault(p, [len(p), None, None])[2] = (n, sorted(ids))
        for p, value in patterns.items():
            self.automaton.add_word(p, tuple(value))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, w: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """(which words are hit, or None; items found) of a text's words."""
        hit, at, found = None, None, set()
        if self.empty or not w:
            return None, found
        norm = b" " + b" ".join(w) + b" "
        for end, (size, places, whole) in self.automaton.iter(norm.decode("latin-1")):
            if at is None:
                at = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
            p = int(np.searchsorted(at, end - size + 1))
            runs = [(p, p + whole[0])] if whole else []
            if whole:
                found.update(whole[1])
            for i, q in places or ():
                item = self.items[i]
                s, e = p, p + self.k
                while s > 0 and q - (p - s) > 0 and p - s < self.n - self.k and w[s - 1] == item[q - (p - s) - 1]:
                    s -= 1
                while e < len(w) and q + (e - p) < len(item) and e - p < self.n and w[e] == item[q + (e - p)]:
                    e += 1
                if e - s >= self.n:
                    runs.append((s, e))
                    if self.ids[i] is not None:
                        found.add(self.ids[i])
            for s, e in runs:
                if hit is None:
                    hit = np.zeros(len(w), bool)
                hit[s:e] = True
        return hit, found


def _matcher(broadcast) -> Matcher:
    """Built once in a worker process; a broadcast holds one block, and a pass over the texts has one block."""
    key, block = broadcast.value
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(block)
    return _MATCHERS[key]


def runs_in(text: bytes, hit: np.ndarray) -> list[dict]:
    """Maximal runs of hit words (w to v), with their code-point offsets in the original text; the normalised text keeps every byte's place."""
    low = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], low.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    first, last = np.flatnonzero(run == 1), np.flatnonzero(run == -1)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"w": int(w), "v": int(v), "start": int(points[starts[w]]), "end": int(points[ends[v - 1]])} for w, v in zip(first, last, strict=True)]


def scan(text: bytes | None, matcher: Matcher) -> tuple[int, list[str], list[dict]]:
    """(words, items found, runs of hit words) of one text."""
    w = words_of(text or b"")
    hit, items = matcher.scan(w)
    return len(w), sorted(items), [] if hit is None else runs_in(text, hit)


def _each_block(spark: SparkSession, benchmark: DataFrame, window: int, max_block_bytes: int) -> Iterator:
    """One broadcast at a time; the one before is dropped when the next is asked for, so what was made with it has to be kept by then."""
    sc = ship(spark).sparkContext
    for block in blocks(benchmark, window, max_block_bytes):
        shared = sc.broadcast((block.key(), block))
        yield shared


def _scanned(docs: DataFrame, shared, every: bool) -> DataFrame:
    """(doc_id, text_key, n_words, items, runs) by a scan with one automaton: of all rows, or of those that are hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for b in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            found = [scan(t, matcher) for t in binary(b, "text")]
            keep = [i for i, f in enumerate(found) if every or f[2]]
            n, items, runs = zip(*(found[i] for i in keep), strict=True) if keep else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(keep, pa.int64())) for c in ("doc_id", "text_key")), pa.array(n, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(runs, _RUNS)],
                names=["doc_id", "text_key", "n_words", "items", "runs"],
            )

    return docs.mapInArrow(run, SCANNED)


def _joined_runs(runs):
    """Runs of several automata, sorted: overlapping and touching ones are one."""
    empty = F.array().cast(RUNS)

    def step(acc, r):
        last = F.element_at(acc, -1)
        more = F.struct(last.w.alias("w"), F.greatest(last.v, r.v).alias("v"), last.start.alias("start"), F.greatest(last.end, r.end).alias("end"))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(more))
        return F.when((F.size(acc) > 0) & (r.w <= F.try_element_at(acc, F.lit(-1)).v), joined).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(runs), empty, step)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_block_bytes: int = 4_000_000) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item: doc_id, n_words, n_hit, items (ids, sorted), spans (code points of the original text).

    ASCII upper-case letters are lowered; words are runs of ASCII letters and digits and of all characters beyond ASCII.
    A null or empty text, or one without words, has no words and no hits, on either side. A benchmark row without an id
    still marks words but is in no list of items; ids that repeat count once. Rows with equal doc_id stay separate rows,
    columns other than doc_id and text are not read, and an empty benchmark marks nothing. Texts have any length.

    One automaton holds all items and a worker builds it once, so each text is scanned once. The automaton takes some 50
    bytes for each of the benchmark, in the driver's memory and in that of each worker; a benchmark of more than max_block_bytes of words
    is taken in blocks of that size, one after another, with a pass over the texts for each that leaves the runs
    of what is hit in the shared folder, and these are joined at the end.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_key"), text.alias("text"))
    passes = _each_block(docs.sparkSession, benchmark, window, max_block_bytes)
    first = next(passes, None) or docs.sparkSession.sparkContext.broadcast(("", Block(window)))
    second = next(passes, None)
    if second is None:
        found = _scanned(docs.withColumn("text_key", F.lit("")), first, True)
    else:
        rows = cut(_scanned(docs, first, True))
        first.unpersist()
        more = []
        for shared in chain([second], passes):
            more.append(cut(_scanned(docs, shared, False)))
            shared.unpersist()
        hits = reduce(DataFrame.unionByName, more).unionByName(rows.where(F.size("runs") > 0)).groupBy("text_key").agg(F.collect_set("items").alias("i"), F.collect_set("runs").alias("r"))
        hits = hits.select("text_key", F.array_sort(F.array_distinct(F.flatten("i"))).alias("items"), _joined_runs(F.flatten("r")).alias("runs"))
        found = rows.select("doc_id", "text_key", "n_words").join(hits, "text_key", "left")
    runs = F.coalesce("runs", F.array().cast(RUNS))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r.v - r.w).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.transform(runs, lambda r: F.struct(r.start.alias("start"), r.end.alias("end"))).alias("spans"),
    )


#: A document is contaminated if one in so many of its words, or more, is hit.
ONE_IN = 20


def is_contaminated(n_hit, n_words):
    return (n_hit > 0) & (ONE_IN * n_hit >= n_words)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_block_bytes: int = 4_000_000) -> DataFrame:
    """The rows of docs, as they are, in which no window of a benchmark item occurs.

    A document goes whole, however small the part of it that is hit: what stays holds no benchmark passage. Null and
    empty texts stay, rows that repeat stay or go together, all columns stay, and an empty table or an empty benchmark
    changes nothing. Automata are bounded as in contamination(); each block's pass takes what the one before kept.
    """
    spark, kept, before = docs.sparkSession, docs, None

    def filtered(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared)
            for b in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
                yield b.filter(pa.array([matcher.scan(words_of(t or b""))[0] is None for t in binary(b, "text")], pa.bool_()))

        return kept.mapInArrow(run, docs.schema)

    for shared in _each_block(spark, benchmark, window, max_block_bytes):
        if before is not None:
            kept = written(kept)
            before.unpersist()
        kept, before = filtered(shared), shared
    return kept


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )
