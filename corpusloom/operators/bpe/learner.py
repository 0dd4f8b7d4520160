"""Greedy merge learning over distinct units with their frequencies: one loop, over sequences held here or dealt over a cluster."""

from __future__ import annotations

import heapq
import logging
import math
import time
from collections import Counter
from collections.abc import Callable, Iterable, Sequence

import numpy as np

from .chain import END, TABLE, Chain, Ranks, encoded
from .model import Merge, Symbols

log = logging.getLogger(__name__)
Pair = tuple[int, int]


def replaced(seq: Sequence[int], a: int, b: int, new: int) -> list[int]:
    """seq with each (a, b) made one, from left to right without overlap."""
    out: list[int] = []
    i, n = 0, len(seq)
    while i < n:
        if i + 1 < n and seq[i] == a and seq[i + 1] == b:
            out.append(new)
            i += 2
        else:
            out.append(seq[i])
            i += 1
    return out


class BestFirst:
    """A queue of pairs by descending count and ascending ids; of a pair's entries only that with its present count holds."""

    def __init__(self, counts: Iterable[tuple[Pair, int]]):
        self.heap = [(-n, p) for p, n in counts]
        heapq.heapify(self.heap)

    def push(self, p: Pair, n: int) -> None:
        heapq.heappush(self.heap, (-n, p))

    def pop(self, counts: dict[Pair, int]) -> Pair | None:
        while self.heap:
            n, p = heapq.heappop(self.heap)
            if n < 0 and counts.get(p) == -n:
                return p
        return None


class Counted:
    """A chain with the frequency of each sequence, and what a merge changes in its weighted pair counts."""

    def __init__(self, chain: Chain, freqs: np.ndarray):
        self.chain, self.freqs = chain, np.asarray(freqs, np.float64)
        self.unit = np.repeat(np.arange(len(freqs), dtype=np.int32), np.diff(chain.ends))
        self.unit = np.concatenate([[0], self.unit]).astype(np.int32)  # the END behind a sequence counts as its

    def _left(self) -> np.ndarray:
        """Places where pairs begin."""
        c = self.chain
        left = np.flatnonzero(c.sym >= 0)
        return left[c.sym[c.nxt[left]] >= 0]

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, count), without places; pairs of a small vocabulary are counted by a table of them, which needs no sorting."""
        c = self.chain
        v = int(c.sym.max(initial=0)) + 1
        if v * v > TABLE:
            return self.pairs()[:2]
        left = self._left()
        n = np.bincount(c.sym[left] * v + c.sym[c.nxt[left]], self.freqs[self.unit[left]], v * v)
        at = np.flatnonzero(n)
        return at // v << 32 | at % v, n[at]

    def pairs(self, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, count, first, places): places of equal pairs lie next to each other from ``first`` on; a key is a * 2^32 + b. With ``wanted`` (sorted keys) of these pairs only."""
        c = self.chain
        left = self._left()
        if wanted is not None:
            left = left[_among(c.sym[left], c.sym[c.nxt[left]], wanted)]
        if not len(left):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)
        a, b = c.sym[left].astype(np.int64), c.sym[c.nxt[left]]
        v = max(int(a.max()), int(b.max())) + 1
        if v * v < 1 << 31:  # pair and place in one integer, which sorts several times as fast as places by pair
            held = np.sort((a * v + b) << 32 | left)
            key, left = held >> 32, (held & 0xFFFFFFFF).astype(np.int32)
        else:
            key = a << 32 | b
            order = np.argsort(key, kind="stable")
            key, left, v = key[order], left[order].astype(np.int32), 1 << 32
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.add.reduceat(self.freqs[self.unit[left]], first)
        return key[first] // v << 32 | key[first] % v, total, first, left

    def merge(self, places: np.ndarray, a: int, b: int, new: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        """(keys of pairs, changes of their counts, weight of what was merged, where it stands now); a key may come more than once."""
        c = self.chain
        p = c.found(places, a, b)
        if not len(p):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0, p
        w = self.freqs[self.unit[p]]
        behind = c.sym[c.nxt[c.nxt[p]]]
        before = c.merge(p, new)
        w_before = self.freqs[self.unit[before]]
        total = int(w.sum())
        keys, change = [np.array([a << 32 | b])], [np.array([-total])]

        def add(symbols: np.ndarray, weight: np.ndarray, high: int | None, low: int | None, sign: int) -> None:
            n = np.bincount(symbols, weight)
            s = np.flatnonzero(n)
            keys.append(s << 32 | low if high is None else high << 32 | s)
            change.append(sign * n[s].astype(np.int64))

        ok = behind >= 0
        add(behind[ok], w[ok], b, None, -1)
        x = c.sym[before]
        add(x, w_before, None, a, -1)
        now = c.sym[c.nxt[p]]
        ok = now >= 0
        add(x, w_before, None, new, 1)
        add(now[ok], w[ok], new, None, 1)
        return np.concatenate(keys), np.concatenate(change), total, p


def _among(a: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the pairs are wanted (sorted keys)."""
    x, y = wanted >> 32, wanted & 0xFFFFFFFF
    side = int(max(x.max(initial=0), y.max(initial=0))) + 2
    if side**2 <= TABLE:
        there = np.zeros(side**2, bool)
        there[x * side + y] = True
        return there[np.minimum(a, side - 1) * side + np.minimum(b, side - 1)]
    key = a.astype(np.int64) << 32 | b
    return wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key


class Located:
    """Counted sequences in which merges are made one after another, each at the cost of what its newest symbol's places are.

    With ``wanted`` (sorted keys) only these pairs of old symbols are located. ``lazily`` looks for each one in all places when it is merged: for few merges that is
    less work than sorting all places by pair, and takes some 35 bytes a symbol instead of 70.
    """

    def __init__(self, counted: Counted, wanted: np.ndarray | None = None, lazily: bool = False):
        self.counted, c = counted, counted.chain
        self.made: dict[int, np.ndarray] = {}
        self.codes, self.side = None, int(c.sym.max(initial=0)) + 1
        if lazily and self.side**2 < 1 << 31:
            behind = c.sym[np.minimum(c.nxt, len(c.sym) - 1)]
            self.codes = np.where((c.sym >= 0) & (behind >= 0), c.sym * np.int32(self.side) + behind, np.int32(-1))
            return
        self.keys, self.n, first, self.places = counted.pairs(wanted)
        self.first = np.append(first, len(self.places))

    def merge(self, a: int, b: int, new: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Keys of pairs, the changes of their counts, and the weight of what was merged. Pairs of old symbols stand where they did at first, others where the newer symbol was made."""
        c = self.counted.chain
        newer = max(a, b)
        if newer in self.made:
            p = self.made[newer]
            p = p[c.sym[p] == newer]
            at = p if newer == a else c.prv[p]
        elif self.codes is not None:
            at = np.flatnonzero(self.codes == a * self.side + b) if newer < self.side else np.zeros(0, np.int64)
        else:
            i = np.searchsorted(self.keys, a << 32 | b)
            at = self.places[self.first[i] : self.first[i + 1]] if i < len(self.keys) and self.keys[i] == a << 32 | b else np.zeros(0, np.int32)
        keys, change, total, self.made[new] = self.counted.merge(at, a, b, new)
        return keys, change, total


class Flat:
    """Counted sequences in which few merges are made one after another: arrays of symbols alone, some ``together`` in each, without links, which a merge goes through and writes anew.

    That takes 4 bytes a symbol and some 12 a sequence, and what a merge needs besides is as large as one array.
    """

    def __init__(self, counted: Iterable[Counted], together: int):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []  # symbols with an END in front of the first sequence and behind each, and frequencies
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for c in counted:
            held.append((c.chain.sym[c.chain.sym >= END], c.freqs))
            n += len(held[-1][0])
            if n >= together:
                self.parts.append(self._one(held))
                held, n = [], 0
        if held:
            self.parts.append(self._one(held))
        self.top = max((int(s.max()) for s, _ in self.parts), default=0)

    @staticmethod
    def _one(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([held[0][0], *[s[1:] for s, _ in held[1:]]]), np.concatenate([f for _, f in held])

    def merge(self, a: int, b: int, new: int) -> tuple[np.ndarray, np.ndarray, int]:
        """As Located.merge()."""
        self.top, total = max(self.top, new), 0
        behind, before, after = np.zeros((3, self.top + 1))
        for i, (s, freqs) in enumerate(self.parts):
            p = np.flatnonzero(s[:-1] == a)
            p = p[s[p + 1] == b]
            if a == b and len(p) > 1:
                fresh = np.concatenate([[True], p[:-1] + 1 != p[1:]])
                at = np.arange(len(p))
                p = p[(at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0]
            if not len(p):
                continue
            w = freqs[np.searchsorted(np.flatnonzero(s == END), p) - 1]
            total += int(w.sum())
            close = p[:-1] + 2 == p[1:]  # two merged pairs side by side
            x, y = s[p - 1], s[p + 2]
            ok = (x >= 0) & np.concatenate([[True], ~close])
            _add(before, x[ok], w[ok])
            _add(behind, y[y >= 0], w[y >= 0])
            y[:-1][close] = new
            _add(after, y[y >= 0], w[y >= 0])
            s[p] = new
            left = np.ones(len(s), bool)
            left[p + 1] = False
            self.parts[i] = s[left], freqs
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        x, y, z = map(np.flatnonzero, (behind, before, after))
        keys = np.concatenate([[a << 32 | b], b << 32 | x, y << 32 | a, y << 32 | new, new << 32 | z])
        return keys, np.concatenate([[-total], -behind[x], -before[y], before[y], after[z]]).astype(np.int64), total


def _add(to: np.ndarray, symbols: np.ndarray, weight: np.ndarray) -> None:
    n = np.bincount(symbols, weight)
    to[: len(n)] += n


class Corpus:
    """Pair and symbol counts of sequences held in this process, and where each pair stands; kept in step merge by merge.

    Memory is some 40 bytes for each symbol. A merge costs what it changes.
    """

    floor = 0

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, freqs: np.ndarray, done: Sequence[Merge] = ()):
        chain = Chain(ids, sizes)
        self.here = Located(Counted(encoded(chain, Ranks(done)) if done else chain, freqs))
        self.pairs: dict[Pair, int] = {(k >> 32, k & 0xFFFFFFFF): n for k, n in zip(self.here.keys.tolist(), map(int, self.here.n.tolist()), strict=True)}
        live = np.flatnonzero(chain.sym >= 0)
        by = np.bincount(chain.sym[live], self.here.counted.freqs[self.here.counted.unit[live]])
        self.symbols: Counter = Counter({s: int(by[s]) for s in np.flatnonzero(by).tolist()})

    @classmethod
    def of(cls, units: Iterable[tuple[Sequence[int], int]], done: Sequence[Merge] = ()) -> Corpus:
        units = list(units)
        ids = np.array([x for s, _ in units for x in s], np.int32)
        return cls(ids, np.array([len(s) for s, _ in units], np.int64), np.array([f for _, f in units], np.int64), done)

    def relist(self, *_, **__) -> bool:
        """All pairs are known here."""
        return True

    def merge(self, merges: list[Merge], upcoming: Callable[[], list[Pair]] | None = None, left: int = 1) -> set[Pair]:
        """Applies merges; returns the pairs whose counts changed."""
        changed: set[Pair] = set()
        for a, b, new in merges:
            keys, n, total = self.here.merge(a, b, new)
            change: Counter = Counter()
            for k, d in zip(keys.tolist(), n.tolist(), strict=True):
                change[k >> 32, k & 0xFFFFFFFF] += d
            changed |= note_changes(self.pairs, self.symbols, change, [(a, b, new, total)])
        return changed

    def seqs(self) -> list[list[int]]:
        return self.here.counted.chain.seqs()


def note_changes(pairs: dict[Pair, int], symbols: Counter, change: dict[Pair, int], merged: list[tuple[int, int, int, int]]) -> set[Pair]:
    for p, d in change.items():
        n = pairs.get(p, 0) + d
        if n > 0:
            pairs[p] = n
        else:
            pairs.pop(p, None)
    for a, b, new, total in merged:
        symbols[a] -= total
        symbols[b] -= total
        symbols[new] += total
    return set(change)


def learn(
    units,
    target: int,
    symbols: Symbols,
    criterion: str = "frequency",
    max_span_words: int | None = None,
    pmi_min_count: int = 5,
    pmi_rebuild_every: int = 300,
    done: Sequence[Merge] = (),
    on_merge: Callable[[list[Merge]], None] | None = None,
    report_every: int = 1000,
) -> tuple[list[Merge], list[list[int]] | None]:
    """Merges until the vocabulary has ``target`` symbols or no candidate is left, and the units as they end (where they are held here).

    units are (ids, frequency), or a function that makes a corpus to which the merges it is given are already applied.
    criterion "frequency": the most frequent pair, of equals the one with the smallest ids. "pmi": the pair with the highest
    log count less those of its symbols, among pairs of pmi_min_count or more; scores are taken when candidates are
    listed, every pmi_rebuild_every merges and when the list runs out. In between a candidate whose score has moved
    is passed over, and pairs that are new wait. Pairs that would span more than max_span_words words are no candidates,
    and learning ends when no others are left. ``done`` are merges of an earlier run, which are applied first. Progress
    is logged every report_every merges.
    """
    merges: list[Merge] = []
    for a, b, new in done:
        if symbols.merged(a, b) != new:
            raise ValueError("the merges done belong to other symbols")
        merges.append((a, b, new))
    corpus = units(merges) if callable(units) else Corpus.of(units, merges)
    fits = lambda p: max_span_words is None or symbols.words_spanned(*p) <= max_span_words

    def pmi(p: Pair) -> float:
        n = corpus.pairs.get(p, 0)
        return math.log(n) - math.log(max(corpus.symbols.get(p[0], 1), 1)) - math.log(max(corpus.symbols.get(p[1], 1), 1)) if n > 0 else -math.inf


    spaces = lambda: np.array([x.count(" ") for x in symbols.strings])
    whole = True  # whether the list has all candidates

    def listed() -> list[tuple[float, Pair]]:
        nonlocal whole
        if criterion == "pmi":
            whole = corpus.relist(max_span_words, spaces, pmi_min_count)
            out = [(-pmi(p), p) for p, n in corpus.pairs.items() if n >= pmi_min_count and fits(p)]
        else:
            corpus.relist(max_span_words, spaces)
            out = [(-n, p) for p, n in corpus.pairs.items() if fits(p)]
        heapq.heapify(out)
        return out

    def listed_farther(seen: set[Pair]) -> list[tuple[float, Pair]]:
        nonlocal whole
        whole = corpus.relist(max_span_words, spaces, pmi_min_count, more=True)
        out = []
        for p in set(corpus.then) - seen:
            n, na, nb = corpus.score_then(p)
            out.append((-(math.log(n) - math.log(max(na, 1)) - math.log(max(nb, 1))), p))
        heapq.heapify(out)
        return out

    heap, since, fresh, began = listed(), 0, True, time.perf_counter()
    seen: set[Pair] = set()  # candidates of a list that goes on
    while len(symbols) < target:
        if criterion == "pmi":
            if not heap:
                if not whole:
                    heap = listed_farther(seen)
                    continue
                if fresh:
                    break
                heap, since, fresh = listed(), 0, True
                seen.clear()
                continue
            key, p = heapq.heappop(heap)
            if not whole:
                seen.add(p)
            if corpus.pairs.get(p, 0) < pmi_min_count or abs(pmi(p) + key) > 1e-9:
                continue
        else:
            key, p = heapq.heappop(heap) if heap else (0, None)
            if -key <= corpus.floor:
                if not corpus.floor:
                    break
                heap = listed()  # others may be as frequent
                continue
            if corpus.pairs.get(p, 0) != -key:
                continue
        now = (*p, symbols.merged(*p))
        left = target - len(symbols) + 1
        upcoming = (lambda: [q for _, q in heapq.nsmallest(min(left, pmi_rebuild_every - since) - 1, heap)]) if criterion == "pmi" else None
        changed = corpus.merge([now], upcoming, left)
        fresh = False
        if criterion == "pmi":
            since += 1
            if since >= pmi_rebuild_every:
                heap, since, fresh = listed(), 0, True
                seen.clear()
        else:
            for q in changed:
                if corpus.pairs.get(q, 0) > corpus.floor and fits(q):
                    heapq.heappush(heap, (-corpus.pairs[q], q))
        merges.append(now)
        if report_every and len(merges) % report_every == 0:
            log.info("%d merges, vocabulary of %d, %.1f s", len(merges), now[2] + 1, time.perf_counter() - began)
        if on_merge:
            on_merge(merges)
    return merges, corpus.seqs()


def learn_by_recount(units: Iterable[tuple[Sequence[int], int]], target: int, symbols: Symbols, max_span_words: int | None = None) -> list[Merge]:
    """The same by frequency, counting everything anew for each merge: slow, and plain enough to test the others against."""
    seqs = [(list(s), f) for s, f in units]
    merges: list[Merge] = []
    while len(symbols) < target:
        n: Counter = Counter()
        for s, f in seqs:
            for p in zip(s, s[1:], strict=False):
                n[p] += f
        n = {p: k for p, k in n.items() if max_span_words is None or symbols.words_spanned(*p) <= max_span_words}
        if not n:
            break
        a, b = min(n, key=lambda p: (-n[p], p))
        new = symbols.merged(a, b)
        merges.append((a, b, new))
        seqs = [(replaced(s, a, b, new), f) for s, f in seqs]
    return merges
