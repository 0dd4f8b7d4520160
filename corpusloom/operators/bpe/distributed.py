"""Learning from tables: distinct units stay dealt over the cluster, and the driver holds a shortlist of pairs with exact counts."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import cut, ship
from ..counts import fingerprint, line_freq, word_freq
from .chain import END, Chain, Ranks, encoded
from .checkpoint import Checkpoint
from .codec import FEW_MERGES, BatchCodec, encode, joined, parts_of
from .learner import BestFirst, Counted, Flat, Located, Pair, learn
from .model import OFFSET, Merge, Model, Symbols, chars_of

#: Symbols of one array of units. Its arrays, some 50 bytes a symbol, lie near the processor: four times as many take up to half as long again for each symbol.
CHUNK = 1 << 18
#: Changes of counts that a task holds before it sums them up.
HELD = 1 << 18
#: Pairs of a shortlist. The driver holds four times as many at most, some 200 bytes each (7 MB).
SHORTLIST = 1 << 13
#: Symbols of the units that proposals of merges are made from, in one task (some 5 bytes each, 0.1 GB; 70 for more than FEW merges); results don't depend on it.
SAMPLE = 1 << 24
#: Up to so many proposals, pairs are looked for one by one, and not sorted, and the sample's symbols have no links.
FEW = 64


def as_symbols(unit, base: dict[str, int]):
    """A text column as a column of symbol characters; base characters are translated in the JVM."""
    return F.translate(unit, "".join(base), chars_of(list(base.values())))


def flat_ids(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of strings of symbol characters."""
    texts = units.to_pylist()
    ids = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int32) - OFFSET
    return ids, np.array(list(map(len, texts)), np.int64)


class Summary:
    """The most frequent pairs of what it has seen, ``most`` of them, in sorted arrays; summaries of parts add up to one of the whole.

    A pair's count is its listed one at least, and that and ``missed`` at most: what is dropped when the list is cut is added to missed.
    """

    def __init__(self, most: int):
        self.most, self.missed = most, 0
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, n: np.ndarray, missed: int = 0) -> None:
        k = np.concatenate([self.keys, keys])
        order = np.argsort(k, kind="stable")
        k, n = k[order], np.concatenate([self.n, n.astype(np.int64)])[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        self.keys, self.n = k[first], np.add.reduceat(n, first) if len(k) else n
        self.missed += missed
        if len(self.keys) > self.most:
            at = np.argpartition(self.n, len(self.n) - self.most)
            self.missed += int(self.n[at[: -self.most]].max())
            kept = np.sort(at[-self.most :])
            self.keys, self.n = self.keys[kept], self.n[kept]


class DealtCorpus:
    """Pair counts of units dealt over the cluster in arrays of some CHUNK symbols (the longest unit's length at least).

    The driver knows ``pairs``, exactly, and that no other pair is more frequent than ``floor``. relist() makes such a list: each task sums up its
    units in a Summary, the sum of these names ``shortlist`` candidates and bounds all others, and the candidates are counted again, exactly, if anything was cut off. Pairs
    that are not listed only lose occurrences, and those of a new symbol are counted when it is made, so the list stays exact while merges are made;
    where the best pair falls to the floor, learn() asks for a new list.

    Merges are made some hundreds in a pass. What they will be is proposed by one task, from a sample of ``sample`` symbols (strided over all units; all of them, if
    there are no more) and the exact counts; the pass then makes them on all units and gives the changes of counts by step, so the driver, which
    takes them one by one, sees whether the next is indeed the best. From the first that is not, the rest is dropped. So the sample decides how many
    merges a pass makes, and never which. Arrays are rewritten every ``rewrite`` merges, by a checkpoint in the shared folder; in between, a pass
    makes the merges since then again.

    With ``texts``, a model, units are plain text, which the tasks that pack them encode first.
    """

    def __init__(self, units: DataFrame, done: Sequence[Merge] = (), rewrite: int = 512, shortlist: int = SHORTLIST, sample: int = SAMPLE, texts: Model | None = None):
        ship(units.sparkSession)
        ranks, self.rewrite, self.shortlist = Ranks(done), rewrite, shortlist
        self.spark, chunk = units.sparkSession, CHUNK
        shared = texts and self.spark.sparkContext.broadcast(texts)

        def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            codec = BatchCodec(shared.value, FEW_MERGES) if shared else None

            def row() -> pa.RecordBatch:
                units_, freqs = (pa.concat_arrays([b.column(c) for b in held]) for c in ("unit", "freq"))
                chain = codec.coded(units_) if codec else Chain(*flat_ids(units_))
                return _packed(encoded(chain, ranks) if ranks.merges else chain, freqs.to_numpy())

            for b in parts_of(batches, "unit", chunk):
                size = pc.sum(pc.utf8_length(b.column("unit"))).as_py() or 0
                if held and n + size > chunk:
                    yield row()
                    held, n = [], 0
                held.append(b)
                n += size
            if held:
                yield row()

        self.base = cut(units.select("unit", F.col("freq").cast("long")).mapInArrow(chunks, _PACKED))
        total = self.base.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.stride = max(1, -(-total // sample))
        stride = self.stride

        def strided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, sizes, freqs in _arrays(batches):
                take = np.arange(len(sizes)) % stride == 0
                yield _row(ids[np.repeat(take, sizes)], sizes[take], freqs[take])

        self.sample = cut(self.base.mapInArrow(strided, _PACKED).repartition(1))
        self.since: list[Merge] = []
        self.pairs: dict[Pair, int] = {}
        self.symbols: Counter = Counter()
        self.floor, self.fits = 0, None
        self.span: tuple[Callable[[], np.ndarray], int] | None = None
        self.ahead: list[tuple[Merge, list[tuple[Pair, int]], int]] = []
        self.most_ahead, self.passes = 512 if self.stride == 1 else 64, 0

    def _sums(self, df: DataFrame, *by: str) -> pa.Table:
        return df.groupBy(*by).agg(F.sum("n").alias("n")).where("n <> 0").toArrow()

    def _chunks(self, since: list[Merge] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[Counted]]:
        """Unpacks chunks and makes the merges since they were written."""
        since = Ranks(self.since if since is None else since)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Counted]:
            for c in _unpacked(batches):
                if since.merges:
                    encoded(c.chain, since)
                yield c

        return run

    def relist(self, max_span_words: int | None = None, spans: Callable[[], np.ndarray] | None = None, pmi_min_count: int | None = None, more: bool = False) -> bool:
        """Makes a new list of pairs, by count or, with pmi_min_count, by PMI among pairs of that count or more; says whether it holds all there are.

        spans gives the number of spaces in each symbol; pairs that span more than max_span_words words are not listed. With ``more`` a PMI list goes farther down
        than the last one, by the scores of that time.
        """
        self._advance()
        self.span = None if max_span_words is None else (spans, max_span_words)
        self.fits = self.span and (spans(), max_span_words)
        if pmi_min_count is not None:
            return self._relist_by_pmi(pmi_min_count, more)
        k = self.shortlist
        while True:
            listed, floor = self._shortlisted(k)
            best = max(listed.values(), default=0)
            if best > floor or not floor:
                self.pairs, self.floor = {p: n for p, n in listed.items() if n > floor}, floor
                return not floor
            k *= 4  # so many pairs are nearly as frequent as the best

    def _shortlisted(self, k: int) -> tuple[dict[Pair, int], int]:
        chunks, fits = self._chunks(), self.fits

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = Summary(k)
            for c in chunks(batches):
                keys, n = c.pair_counts()
                if fits is not None:
                    ok = fits[0][keys >> 32] + fits[0][keys & 0xFFFFFFFF] < fits[1]
                    keys, n = keys[ok], n[ok]
                s.add(keys, n)
            yield _rows(np.append(s.keys >> 32, -1), np.append(s.keys & 0xFFFFFFFF, -1), np.append(s.n, s.missed))

        sums = self.base.mapInArrow(summed, _COUNTS).groupBy("a", "b").agg(F.sum("n").alias("n"))
        t = sums.orderBy(F.col("a") >= 0, F.desc("n"), "a", "b").limit(k + 2).toArrow()  # what was missed comes first
        rows = list(zip(*(t.column(c).to_pylist() for c in ("a", "b", "n")), strict=True))
        missed = rows.pop(0)[2] if rows else 0
        beyond = rows.pop()[2] if len(rows) > k else 0
        listed = {(a, b): n for a, b, n in rows}
        return (self._recounted(listed) if missed else listed), missed + beyond

    def _recounted(self, wanted) -> dict[Pair, int]:
        """The exact counts of the pairs wanted."""
        keys = self.spark.sparkContext.broadcast(np.sort(np.array([a << 32 | b for a, b in wanted], np.int64)))
        chunks = self._chunks()

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            want = keys.value
            total = np.zeros(len(want), np.int64)
            for c in chunks(batches):
                k, n = c.pair_counts()
                at = np.searchsorted(want, k)
                ok = (at < len(want)) & (want[np.minimum(at, len(want) - 1)] == k)
                total[at[ok]] += n[ok].astype(np.int64)
            yield _rows(want >> 32, want & 0xFFFFFFFF, total)

        t = self._sums(self.base.mapInArrow(counted, _COUNTS), "a", "b")
        return {(a, b): n for a, b, n in zip(*(t.column(c).to_pylist() for c in ("a", "b", "n")), strict=True)}

    def _relist_by_pmi(self, least: int, more: bool) -> bool:
        if not more:
            self.frozen, self.listed = (self.base, list(self.since)), self.shortlist
        else:
            self.listed *= 4
        base, since = self.frozen
        chunks, fits = self._chunks(since), self.fits

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c in chunks(batches):
                keys, n = c.pair_counts()
                if fits is not None:
                    ok = fits[0][keys >> 32] + fits[0][keys & 0xFFFFFFFF] < fits[1]
                    keys, n = keys[ok], n[ok]
                live = np.flatnonzero(c.chain.sym >= 0)
                by = np.bincount(c.chain.sym[live], c.freqs[c.unit[live]])
                s = np.flatnonzero(by)
                yield _rows(np.concatenate([keys >> 32, s]), np.concatenate([keys & 0xFFFFFFFF, np.full(len(s), END)]), np.concatenate([n, by[s]]))

        sums = base.mapInArrow(counted, _COUNTS).groupBy("a", "b").agg(F.sum("n").alias("n"))
        if not more:
            self.symbols = Counter({r.a: r.n for r in sums.where(F.col("b") == END).collect()})  # as many as the vocabulary has
        of = np.ones(max(self.symbols, default=0) + 1)
        for s, n in self.symbols.items():
            of[s] = max(n, 1)
        if more:
            of = self.symbols_then
        self.symbols_then = of

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y, n = (b.column(c).to_numpy() for c in ("a", "b", "n"))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.log(n) - np.log(of[x]) - np.log(of[y]))], names=["a", "b", "n", "score"])

        frequent = sums.where((F.col("b") != END) & (F.col("n") >= least)).select("a", "b", "n")
        t = frequent.mapInArrow(scored, "a long, b long, n long, score double").orderBy(F.desc("score"), "a", "b").limit(self.listed + 1).toArrow()
        rows = list(zip(*(t.column(c).to_pylist() for c in ("a", "b", "n")), strict=True))
        whole = len(rows) <= self.listed
        self.then = {(a, b): n for a, b, n in rows[: self.listed]}
        self.pairs, self.floor = (self._recounted(self.then) if more else dict(self.then)), 0
        return whole

    def score_then(self, p: Pair) -> tuple[int, float, float]:
        """A listed pair's count and its symbols' at the time of the list."""
        return self.then[p], self.symbols_then[p[0]], self.symbols_then[p[1]]

    def merge(self, merges: list[Merge], upcoming: Callable[[], list[Pair]] | None = None, left: int = 1) -> set[Pair]:
        """Applies a merge, as proposed in an earlier pass or by a new one, which makes ``left`` merges at most; returns the listed pairs whose counts changed.

        upcoming gives the pairs that are likely to come next; without it they are proposed from the sample.
        """
        changed: set[Pair] = set()
        for m in merges:
            if not self.ahead or self.ahead[0][0] != m:
                self._pass(m, upcoming, left)
            _, change, total = self.ahead.pop(0)
            self.taken += 1
            for p, d in change:
                n = self.pairs.get(p, 0) + d
                if n > self.floor:
                    self.pairs[p] = n
                else:
                    self.pairs.pop(p, None)
                changed.add(p)
            for s, d in ((m[0], -total), (m[1], -total), (m[2], total)):
                self.symbols[s] += d
            self.since.append(m)
        if len(self.pairs) > 4 * self.shortlist and upcoming is None:
            at = np.sort(np.fromiter(self.pairs.values(), np.int64))[-self.shortlist]
            self.floor = int(at)
            self.pairs = {p: n for p, n in self.pairs.items() if n > self.floor}
        return changed

    def _advance(self) -> None:
        """Forgets what was proposed, and rewrites the arrays where many merges were made since they were written."""
        self.ahead = []
        if len(self.since) >= self.rewrite:
            chunks = self._chunks()

            def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for c in chunks(batches):
                    yield _packed(c.chain, c.freqs)

            self.base, self.sample = cut(self.base.mapInArrow(rewritten, _PACKED)), cut(self.sample.mapInArrow(rewritten, _PACKED))
            self.since = []

    def _pass(self, first: Merge, upcoming: Callable[[], list[Pair]] | None, left: int) -> None:
        if self.passes:
            self.most_ahead = min(512, 2 * self.most_ahead) if not self.ahead else max(16, min(self.most_ahead, 2 * self.taken))
        self._advance()
        self.passes, self.taken = self.passes + 1, 0
        pairs = [first[:2], *[p for p in upcoming() if p != first[:2]]][: self.most_ahead] if upcoming else self._proposed(first, min(left, self.most_ahead))
        steps = [(a, b, first[2] + i) for i, (a, b) in enumerate(pairs)]
        listed = self.spark.sparkContext.broadcast(np.sort(np.array([a << 32 | b for a, b in self.pairs], np.int64)))
        chunks, new, born = self._chunks(), first[2], upcoming is None  # under PMI pairs of new symbols wait for the next list
        wanted = np.sort(np.array([a << 32 | b for a, b, _ in steps if max(a, b) < new], np.int64))

        def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, parts, held = listed.value, [], 0
            for c in chunks(batches):
                here = Located(c, wanted, lazily=len(steps) <= FEW)
                for i, (a, b, s) in enumerate(steps):
                    keys, n, total = here.merge(a, b, s)
                    at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                    ok = (known[at] == keys) if len(known) else np.zeros(len(keys), bool)
                    if born:
                        ok |= (keys >> 32 >= new) | (keys & 0xFFFFFFFF >= new)
                    keys, n = np.append(keys[ok], -1), np.append(n[ok], total)
                    parts.append((np.full(len(keys), i), keys, n))
                    held += len(keys)
                if held > HELD:
                    parts = [_summed(parts)]
                    held = len(parts[0][0])
                    if held > HELD // 2:
                        yield _changes(parts.pop())
                        held = 0
            if parts:
                yield _changes(_summed(parts))

        sums = self.base.mapInArrow(changes, "step long, key long, n long").groupBy("step", "key").agg(F.sum("n").alias("n"))
        fresh = (F.shiftright("key", 32) >= new) | (F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)) >= new)
        t = sums.where((F.col("key") < 0) | (F.col("n") < 0) | ~fresh | (F.col("n") > self.floor)).where("n <> 0").toArrow()  # a pair that is new and no more frequent than the floor never will be
        by: list[tuple[Merge, list[tuple[Pair, int]], int]] = [(m, [], 0) for m in steps]
        for i, k, n in zip(*(t.column(c).to_pylist() for c in ("step", "key", "n")), strict=True):
            if k < 0:
                by[i] = (*by[i][:2], n)
            else:
                by[i][1].append(((k >> 32, k & 0xFFFFFFFF), n))
        self.ahead = by

    def _proposed(self, first: Merge, most: int) -> list[Pair]:
        """The merges from ``first`` on, ``most`` at most, as the sample and the listed counts have it."""
        count = self.spark.sparkContext.broadcast((np.array(list(self.pairs), np.int64).reshape(-1, 2), np.array(list(self.pairs.values()), np.int64)))
        chunks, floor, stride, fits = self._chunks(), self.floor, self.stride, self.span and (self.span[0]()[: first[2]], self.span[1])

        def proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, n = count.value
            known = dict(zip(map(tuple, keys.tolist()), n.tolist(), strict=True))
            spaces = fits[0].tolist() if fits else None
            out: list[Pair] = []
            here = Flat(chunks(batches), CHUNK) if most <= FEW else Located(_as_one(chunks(batches)))
            heap, m = BestFirst(known.items()), first
            while m:
                out.append(m[:2])
                keys, change, _ = here.merge(*m)
                if spaces is not None:
                    spaces.append(spaces[m[0]] + spaces[m[1]])
                born = (keys >> 32 == m[2]) | (keys & 0xFFFFFFFF == m[2])
                ok = ~born | (stride * change > floor)
                for k, d in zip(keys[ok].tolist(), change[ok].tolist(), strict=True):
                    p = (k >> 32, k & 0xFFFFFFFF)
                    if p in known or (max(p) == m[2] and (spaces is None or spaces[p[0]] + spaces[p[1]] < fits[1])):
                        known[p] = known.get(p, 0) + stride * d
                        heap.push(p, known[p])
                known.pop(m[:2], None)
                best = heap.pop(known) if len(out) < most else None
                m = (*best, m[2] + 1) if best and known[best] > floor else None
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in enumerate(out)], pa.int64()), *[pa.array([p[j] for p in out], pa.int64()) for j in (0, 1)]], names=["i", "a", "b"])

        rows = self.sample.mapInArrow(proposed, "i long, a long, b long").collect()  # ``most`` rows
        return [(r.a, r.b) for r in sorted(rows)] or [first[:2]]

    def seqs(self) -> None:
        return None


_PACKED, _COUNTS = "ids binary, sizes binary, freqs binary, n long", "a long, b long, n long"


def _packed(chain: Chain, freqs: np.ndarray) -> pa.RecordBatch:
    return _row(chain.ids(), chain.counts(), np.asarray(freqs))


def _row(ids: np.ndarray, sizes: np.ndarray, freqs: np.ndarray) -> pa.RecordBatch:
    """A chunk as a row; ids have two bytes where all fit."""
    kind = "<u2" if ids.max(initial=0) < 1 << 16 else "<i4"
    parts = (ids.astype(kind), sizes.astype("<i4"), freqs.astype("<i8"))
    return pa.RecordBatch.from_arrays([*[pa.array([x.tobytes()], pa.binary()) for x in parts], pa.array([len(ids)], pa.int64())], names=["ids", "sizes", "freqs", "n"])


def _as_one(counted: Iterator[Counted]) -> Counted:
    """Chunks put together in one."""
    none = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
    ids, sizes, freqs = map(np.concatenate, zip(none, *((c.chain.ids(), c.chain.counts(), c.freqs) for c in counted), strict=True))
    return Counted(Chain(ids, sizes), freqs)


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ids, sizes and freqs of each row, which are not copied out of their batch, one row at a time."""
    for b in batches:
        for i in range(b.num_rows):
            ids, sizes, freqs = (b.column(c)[i].as_buffer() for c in ("ids", "sizes", "freqs"))
            n = b.column("n")[i].as_py()
            yield np.frombuffer(ids, "<u2" if ids.size == 2 * n else "<i4"), np.frombuffer(sizes, "<i4"), np.frombuffer(freqs, "<i8")
        b = ids = sizes = freqs = None  # else this batch would be held while the next one is read  # noqa: PLW2901


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Counted]:
    for ids, sizes, freqs in _arrays(batches):
        yield Counted(Chain(ids, sizes), freqs)


def _rows(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(np.int64)) for x in (a, b, n)], names=["a", "b", "n"])


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step, key, n) of several such, each step's key once."""
    step, keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((keys, step))
    step, keys, n = step[order], keys[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (step[1:] != step[:-1]) | (keys[1:] != keys[:-1])])) if len(step) else np.zeros(0, np.int64)
    return step[first], keys[first], np.add.reduceat(n, first) if len(first) else n


def _changes(summed: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in summed], names=["step", "key", "n"])


def characters(units: DataFrame) -> list[str]:
    """The different characters of units, by their codes. Those of one byte that were seen before are struck out of a batch's bytes, and only what is left is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, plain = np.zeros(0x110000, bool), b""
        for b in parts_of(batches, "unit", CHUNK):
            left = joined(b.column("unit")).to_pybytes().translate(None, plain)
            if left:
                seen[np.frombuffer(left.decode().encode("utf-32-le"), "<u4")] = True
                plain = bytes(np.flatnonzero(seen[:0x80]).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(map(chr, np.flatnonzero(seen).tolist()), pa.string())], names=["c"])

    ship(units.sparkSession)
    return sorted(r.c for r in units.select("unit").mapInArrow(run, "c string").distinct().collect())


def learn_units(units: DataFrame, target: int, symbols: Symbols, checkpoint: Checkpoint | None = None, more: bool = False, dealt: dict | None = None, **how) -> list[Merge]:
    """Merges of units (unit string, freq long) up to ``target`` symbols, or with more by so many merges.

    Characters that the alphabet does not have are added first, in the order of their codes. Units are computed once, written, and stay dealt over
    the cluster: see DealtCorpus for what the driver holds; dealt are its options.
    """
    units = cut(units.select("unit", F.col("freq").cast("long").alias("freq")))
    for c in characters(units):
        symbols.id_of(c)
    if checkpoint:  # which knows units by their symbols
        units = units.select(as_symbols(F.col("unit"), symbols.base).alias("unit"), "freq")
    else:
        dealt = (dealt or {}) | {"texts": Model(list(symbols.strings), [], [])}
    return _learn(units, target + more * len(symbols), symbols, checkpoint, dealt, **how)


def _learn(units: DataFrame, target: int, symbols: Symbols, checkpoint: Checkpoint | None, dealt: dict | None = None, **how) -> list[Merge]:
    def corpus(done: list[Merge]) -> DealtCorpus:
        return DealtCorpus(units, done, **dealt or {})

    if checkpoint is None:
        return learn(corpus, target, symbols, **how)[0]
    units = cut(units)
    mark = fingerprint(units).first()
    return checkpoint.run(corpus, target, symbols, f"{mark.fingerprint}:{(mark.content or 0) & (2**64 - 1):016x}", **how)


def train(lines: DataFrame, stage1: int = 12_000, vocab: int = 20_000, checkpoint: str | None = None, checkpoint_every: int = 500, more: bool = False, dealt: dict | None = None, **stage2) -> Model:
    """The two-stage vocabulary of lines (text): merges inside words up to ``stage1`` symbols, then merges across spaces up to ``vocab``.

    With more, stage1 and vocab are numbers of merges. Stage 2 sees each distinct line as stage 1 encodes it, with its
    spaces back between all parts. Options for stage 2: max_span_words, criterion, pmi_min_count, pmi_rebuild_every. With
    a checkpoint folder, both stages resume there.
    """
    symbols = Symbols()
    mark = lambda k: Checkpoint(f"{checkpoint}/stage{k}.json", checkpoint_every) if checkpoint else None
    first = learn_units(word_freq(lines), stage1, symbols, mark(1), more, dealt)
    done = Model(list(symbols.strings), first, [])
    units = line_freq(lines)
    if checkpoint:  # which knows units by their symbols
        units = encode(units, done, "unit", as_chars=True).select(F.col("ids").alias("unit"), "freq")
    else:
        dealt = (dealt or {}) | {"texts": done}
    return Model(symbols.strings, first, _learn(units, vocab + more * len(symbols), symbols, mark(2), dealt, **stage2))


def train_words(lines: DataFrame, vocab: int = 20_000, more: bool = False) -> Model:
    """The one-stage baseline: merges inside words alone. Its reports count no tokens for white space (compression with mode "words")."""
    symbols = Symbols()
    merges = learn_units(word_freq(lines), vocab, symbols, more=more)
    return Model(symbols.strings, merges, [])


def seconds_per_merge(lines: DataFrame, stage1: Model, merges: int = 300, project: int = 12_000) -> dict[str, float]:
    """How long a stage-2 merge takes over some, and the time for ``project`` of them at that rate."""
    symbols = Symbols(list(stage1.strings))
    units = line_freq(lines)
    began = time.perf_counter()
    done = len(_learn(units, len(symbols) + merges, symbols, None, {"texts": stage1}))
    rate = (time.perf_counter() - began) / max(done, 1)
    return {"merges": done, "seconds_per_merge": rate, "projected_s": rate * project}
