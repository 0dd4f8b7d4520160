"""Symbol sequences end to end in flat arrays with links: a merge is a few array operations on the places where its pair stands."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np

END, GONE = -1, -2
_NONE = np.iinfo(np.int64).max
#: Entries of a table of ranks by pair of symbols, 8 bytes each; larger vocabularies' pairs are searched for.
TABLE = 1 << 19


class Chain:
    """Sequences with an END in front of the first and behind each; places of symbols merged away are GONE."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        n, k = len(ids), len(sizes)
        self.sym = np.full(n + k + 1, END, np.int32)
        self.ends = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64) + 1)])
        place = np.ones(n + k + 1, bool)
        place[self.ends] = False
        self.sym[place] = ids
        self.nxt = np.arange(1, n + k + 2, dtype=np.int32)
        self.prv = np.arange(-1, n + k, dtype=np.int32)

    def found(self, places: np.ndarray, a: int, b: int) -> np.ndarray:
        """Those of the places, in order, where the pair stands now; of overlapping ones (a pair of equal symbols) the first, third and so on."""
        p = np.sort(places)
        p = p[self.sym[p] == a]
        p = p[self.sym[self.nxt[p]] == b]
        if a == b and len(p) > 1:
            fresh = np.concatenate([[True], self.nxt[p[:-1]] != p[1:]])
            at = np.arange(len(p))
            p = p[(at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0]
        return p

    def merge(self, p: np.ndarray, new: int | np.ndarray) -> np.ndarray:
        """Makes one symbol of the pairs at places p (the same for all, or one for each); returns the places in front of them that are none of them."""
        q = self.nxt[p]
        r = self.nxt[q]
        before = self.prv[p]
        before = before[np.concatenate([[True], before[1:] != q[:-1]])] if len(p) else before
        self.sym[p] = new
        self.sym[q] = GONE
        self.nxt[p] = r
        self.prv[r] = p
        return before[self.sym[before] != END]

    def counts(self) -> np.ndarray:
        """Symbols left by sequence."""
        live = np.concatenate([[0], np.cumsum(self.sym >= 0)])
        return live[self.ends[1:]] - live[self.ends[:-1]]

    def ids(self) -> np.ndarray:
        return self.sym[self.sym >= 0]

    def seqs(self) -> list[list[int]]:
        at = np.concatenate([[0], np.cumsum(self.counts())])
        flat = self.ids().tolist()
        return [flat[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


class Ranks:
    """Merges by rank, and the rank of any pair."""

    def __init__(self, merges: Sequence[tuple[int, int, int]]):
        m = np.array(merges, np.int64).reshape(-1, 3)
        key = m[:, 0] << 32 | m[:, 1]
        self.merges, self.new = m.tolist(), m[:, 2].astype(np.int32)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self._blocks: dict[tuple[int, ...], np.ndarray] = {}
        self.side = int(m[:, :2].max()) + 2 if len(m) else 1  # the last row and column stand for all that is no symbol of a merge
        self.table = None
        if self.side**2 <= TABLE:
            self.table = np.full(self.side**2, _NONE)
            self.table[m[::-1, 0] * self.side + m[::-1, 1]] = np.arange(len(m))[::-1]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), _NONE)
        if self.table is not None:
            last = np.uint32(self.side - 1)
            x, y = (np.minimum(np.asarray(s, np.int32).view(np.uint32), last) for s in (a, b))
            return self.table[x * np.uint32(self.side) + y]
        key = a.astype(np.int64) << 32 | b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (a >= 0) & (b >= 0), self.order[i], _NONE)

    def blocks(self, stops: Sequence[int] = ()) -> np.ndarray:
        """The block of each rank: as many merges in a row as use no symbol that one of them makes, none of them across a stop."""
        at = tuple(sorted(set(stops)))
        if at not in self._blocks:
            out, k, made = np.zeros(len(self.merges), np.int64), 0, set()
            for r, (a, b, new) in enumerate(self.merges):
                if a in made or b in made or r in at:
                    k += 1
                    made.clear()
                made.add(new)
                out[r] = k
            self._blocks[at] = out
        return self._blocks[at]


def chosen(p: np.ndarray, r: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Which of the pairs at places p, in order, are merged if the lowest rank goes first, of one rank the leftmost, and a pair goes that overlaps a merged one.

    Runs of overlapping pairs of equal rank that are lower than their neighbours are settled at once, every other one of them merged, then what they leave.
    """
    out = np.zeros(len(p), bool)
    alive = np.arange(len(p))
    while n := len(alive):
        at, rank = p[alive], r[alive]
        link = nxt[at[:-1]] == at[1:]  # overlaps the next one
        first = np.flatnonzero(np.concatenate([[True], ~link | (rank[1:] != rank[:-1])]))
        low = np.concatenate([[True], ~link[first[1:] - 1] | (rank[first[1:]] < rank[first[1:] - 1])])
        low[:-1] &= ~link[first[1:] - 1] | (rank[first[:-1]] < rank[first[1:]])
        size = np.diff(np.append(first, n))
        take = np.repeat(low, size) & ((np.arange(n) - np.repeat(first, size)) % 2 == 0)
        out[alive[take]] = True
        gone = take.copy()
        gone[1:] |= link & take[:-1]
        gone[:-1] |= link & take[1:]
        alive = alive[~gone]
    return out


def apply_ranks(chain: Chain, ranks: Ranks, stops: Sequence[int] = ()) -> Iterator[np.ndarray]:
    """Encodes the chain in the order of ranks; before the merge of each rank in ``stops``, and at the end, gives the symbols left by sequence.

    A merge creates no pair of a lower rank, so one pass in this order is what merging the lowest rank again and again gives. And the merges of a block create none
    of the block, so they are made together, once overlaps are settled by rank: steps are as many as blocks, a small part of the merges.
    """
    block = ranks.blocks(stops)
    first = np.searchsorted(block, np.arange(int(block[-1]) + 1 if len(block) else 0))  # ranks of blocks' first merges
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(places: np.ndarray) -> None:
        noted(places, ranks.of(chain.sym[places], chain.sym[chain.nxt[places]]))

    def noted(places: np.ndarray | None, r: np.ndarray) -> None:
        ok = np.flatnonzero(r < _NONE)
        places, k = ok if places is None else places[ok], block[r[ok]]
        if not len(k):
            return
        order = np.argsort(k, kind="stable")
        places, k = places[order], k[order]
        cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(k)], strict=True):
            b = int(k[s])
            if b not in waiting:
                waiting[b] = []
                heapq.heappush(heap, b)
            waiting[b].append(places[s:e])

    if (chain.sym == GONE).any():
        note(np.flatnonzero(chain.sym >= 0))
    elif len(ranks.merges):  # all as it was made: each place's next one lies behind it
        noted(None, ranks.of(chain.sym[:-1], chain.sym[1:]))
    left = sorted(stops)
    while heap:
        k = heapq.heappop(heap)
        while left and left[0] <= first[k]:
            yield chain.counts()
            left.pop(0)
        p = np.sort(np.concatenate(waiting.pop(k)))
        p = p[np.concatenate([[True], p[1:] != p[:-1]])]
        r = ranks.of(chain.sym[p], chain.sym[chain.nxt[p]])
        ok = r < _NONE
        ok[ok] = block[r[ok]] == k
        p, r = p[ok], r[ok]
        if len(p):
            ok = chosen(p, r, chain.nxt)
            p = p[ok]
            note(np.concatenate([chain.merge(p, ranks.new[r[ok]]), p]))
    for _ in left:
        yield chain.counts()
    yield chain.counts()


def encoded(chain: Chain, ranks: Ranks) -> Chain:
    for _ in apply_ranks(chain, ranks):
        pass
    return chain
