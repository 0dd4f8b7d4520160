"""Suffix-array dedup: byte strings that repeat across documents, found by suffix arrays over what can repeat at all."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, cut_by, release, table

#: Length of the byte strings whose hashes are seeds; every string looked for holds several.
GRAM = 20
#: Positions that one suffix array holds.
BLOCK = 1 << 18
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def gram_hashes(a: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on, by doubling."""
    x = {1: _BYTE[a]}
    for n in (1, 2, 4, 8):
        x[2 * n] = x[n][:-n] * _power(n) + x[n][n:]
    n = len(a) - GRAM + 1
    h = x[16][:n] * _power(4) + x[4][16 : 16 + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def least_positions(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of w hashes the place of the least (by its upper half; the first of equal ones), from block-wise running minima."""
    n = len(h) - w + 1
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    pad = -len(key) % w
    rows = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def seeds(texts: list[bytes], length: int, chunk: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, windows, hash) of each run of windows of ``length`` bytes that share the place of their least gram hash.

    Equal windows have equal hashes, whatever stands around them. Long texts are taken in chunks, which only cuts runs.
    """
    out: list[tuple] = []
    held: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        buf = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        size = np.array([len(p) for _, _, p in held])
        end = np.cumsum(size)
        if len(buf) < length:
            return
        h = gram_hashes(buf)
        at = least_positions(h, length - GRAM + 1)
        ok = np.ones(len(buf), bool)
        for e in end.tolist():
            ok[max(0, e - length + 1) : e] = False
        start = np.flatnonzero(ok[: len(at)])
        if not len(start):
            return
        p = at[start]
        new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        first = start[new]
        k = np.searchsorted(end, first, side="right")
        t, o = (np.array(v, np.int64)[k] for v in zip(*[(i, o) for i, o, _ in held], strict=True))
        mixed = h[p[new]] * np.uint64(0xD1B54A32D192ED03)  # the least hashes are small ones: spread over all ranges again
        out.append((t, first - (end - size)[k] + o, np.diff(np.append(new, len(start))), mixed))

    n = 0
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text) - length + 1), chunk):
            piece = text[a : a + chunk + length - 1]
            if len(piece) < length:
                continue
            held.append((i, a, piece))
            n += len(piece)
            if n >= chunk:
                flush()
                held, n = [], 0
    if held:
        flush()
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))


def _order(key: np.ndarray, bits: int) -> np.ndarray:
    """Places in the order of their keys, of equal keys by place, with places in the lowest bits: values sort faster than places do."""
    k = np.sort(key.astype(np.uint64) << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
    return (k & np.uint64((1 << bits) - 1)).astype(np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffixes of s in order: values from 1 to 256, and 0 behind each text, which counts as a different, smaller symbol each time, by place.

    Larsson and Sadakane's refinement: suffixes are sorted by their first symbols (as many as fit beside a place), and then
    only groups that are not yet told apart are sorted again, by the ranks of what follows, with twice as many symbols each time.
    """
    n = len(s)
    bits = n.bit_length()
    used = np.zeros(257, bool)
    used[s] = used[0] = True
    name = np.cumsum(used) - 1
    base = int(name[-1]) + 1
    h = 1
    while base ** (h + 1) < 1 << (64 - bits):
        h += 1
    padded = np.concatenate([name[s], np.zeros(h, np.int64)])
    stops = np.flatnonzero(s == 0)
    left = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
    key = np.zeros(n, np.int64)
    for i in range(h):
        key = key * base + padded[i : i + n] * (left > i)
    sa = _order(key, bits)
    key = key[sa]
    head = np.concatenate([[True], key[1:] != key[:-1]]) | (left[sa] < h)  # equal keys are by place where a 0 is in reach
    while True:
        if head.all():
            return sa
        group = np.flatnonzero(head)[np.cumsum(head) - 1]  # the place of a group's first member is its name
        rank = np.empty(n + 1, np.int64)
        rank[sa] = group
        rank[n] = -1
        open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
        after, g = rank[np.minimum(sa[open_] + h, n)], group[open_]
        dense = np.cumsum(np.concatenate([[True], g[1:] != g[:-1]])) - 1
        bits = len(open_).bit_length()
        key = dense * (n + 2) + after + 1
        order = _order(key, bits) if (int(dense[-1]) + 1) * (n + 2) < 1 << (64 - bits) else np.argsort(key, kind="stable")
        sa[open_], f = sa[open_[order]], after[order]
        head[open_] = np.concatenate([[True], (g[1:] != g[:-1]) | (f[1:] != f[:-1])])
        h *= 2


def common_prefixes(s: np.ndarray, sa: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """By place in sa, how many symbols (``most`` at most, and within its text) a suffix shares with the one before: Kasai's rule, that dropping a first symbol costs one at most, walked through all texts abreast."""
    n = len(s)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    before = np.concatenate([[-1], sa[:-1]])[place]
    out = np.zeros(n, np.int64)
    order = np.argsort(starts - ends, kind="stable")  # longest first, so that those still walking come first
    starts, ends = starts[order], ends[order]
    size = ends - starts
    had = np.zeros(len(starts), np.int64)
    live = len(starts)
    for t in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, side="left"))
        i = starts[:live] + t
        j = before[i]
        common = np.maximum(had[:live] - 1, 0)
        common[j < 0] = 0
        go = np.flatnonzero((j >= 0) & (common < most))
        while len(go):
            a, b = i[go] + common[go], j[go] + common[go]
            ok = (a < ends[go]) & (b < n)
            ok[ok] = s[a[ok]] == s[b[ok]]
            go = go[ok]
            common[go] += 1
            go = go[common[go] < most]
        out[place[i]] = common
        had[:live] = common
    return out


def _rows(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The strings of ``length`` bytes at these places, which compare as bytes do."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length)[at]).view(f"S{length}").ravel()


def binary_search(sorted_rows: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the place among the sorted rows where it is or would be, and whether it is there."""
    at = np.searchsorted(sorted_rows, rows)
    there = at < len(sorted_rows)
    there[there] = sorted_rows[at[there]] == rows[there]
    return at, there


def merged(parts: list[tuple[np.ndarray, np.ndarray]], merged_at: list[int] | None = None) -> list[np.ndarray]:
    """For each part (different sorted windows, their documents) the smallest documents that any part has for its windows.

    Neighbours are merged two by two, and what comes of them again, so that a window is looked up as often as the number of parts can be halved.
    """
    level = [(rows, docs) for rows, docs in parts]
    # of each part: which of a level's members holds it, and the places of its windows there
    place = [np.arange(len(rows)) for rows, _ in parts]
    member = np.arange(len(parts))
    while len(level) > 1:
        out, to = [], []
        for k in range(0, len(level), 2):
            if k + 1 == len(level):
                out.append(level[k])
                to.append(None)
                continue
            (a, low), (b, more) = level[k], level[k + 1]
            at, there = binary_search(a, b)
            low = low.copy()
            low[at[there]] = np.minimum(low[at[there]], more[there])
            new = np.flatnonzero(~there)
            of_b = np.empty(len(b), np.int64)
            of_b[new] = at[new] + np.arange(len(new))
            of_a = np.arange(len(a)) + np.searchsorted(at[new], np.arange(len(a)), side="right")
            of_b[there] = of_a[at[there]]
            out.append((np.insert(a, at[new], b[new]), np.insert(low, at[new], more[new])))
            to += [of_a, of_b]
            if merged_at is not None:
                merged_at.append(int(there.sum()))
        for k, m in enumerate(member.tolist()):
            if to[m] is not None:
                place[k] = to[m][place[k]]
        member //= 2
        level = out
    return [level[0][1][p] for p in place]


def first_documents(regions: list[bytes], docs: np.ndarray, length: int, block: int = BLOCK, of_seed: np.ndarray | None = None, merged_at: list[int] | None = None) -> list[np.ndarray]:
    """For each region and each of its windows the smallest document among all regions that hold the same bytes.

    Regions are split into blocks; each has its suffix array and common prefixes, which put equal windows next to each
    other. Blocks are then merged: the windows of one are looked up by binary search in the sorted windows of another. With
    of_seed, which never decreases, regions of different seeds share no window, so that only the windows of a seed
    on which blocks border are looked up; without it all blocks are merged with each other. merged_at is told how many windows each merge has met.
    """
    n_windows = np.array([len(r) - length + 1 for r in regions])
    seed = np.zeros(len(regions), np.int64) if of_seed is None else of_seed
    best = np.repeat(docs, n_windows)
    base = np.concatenate([[0], np.cumsum(n_windows)])
    # of each block: sorted windows of its first and last seed where it borders, their seeds and groups; the groups' documents; place and group of each window; the two seeds
    blocks: list[tuple] = []
    at = 0
    while at < len(regions):
        end, size = at, 0
        while end < len(regions) and (end == at or size + len(regions[end]) < block):
            size += len(regions[end]) + 1
            end += 1
        part = regions[at:end]
        lens = np.array([len(r) for r in part])
        text = np.frombuffer(b"\0".join(part) + b"\0", np.uint8)
        s = text.astype(np.int16) + 1
        ends = np.cumsum(lens + 1) - 1
        starts = ends - lens
        s[ends] = 0
        sa = suffix_array(s)
        lcp = common_prefixes(s, sa, starts, ends, length)
        edge = np.zeros(len(s) + 1, np.int8)
        edge[starts] += 1
        edge[starts + n_windows[at:end]] -= 1
        place = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)[sa]
        # a window's first ``length`` symbols hold no separator, so all suffixes that share them are windows
        group = np.cumsum(lcp[place] < length) - 1
        where = sa[place]
        owner = np.searchsorted(ends, where, side="right")
        flat = base[at + owner] + where - starts[owner]
        doc = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(doc, group, docs[at + owner])
        best[flat] = doc[group]
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        own = seed[at + owner[heads]]
        border = np.flatnonzero((own == (seed[at] if at and seed[at - 1] == seed[at] else -1)) | (own == (seed[end - 1] if end < len(regions) and seed[end] == seed[end - 1] else -1)))
        mine = np.flatnonzero(np.isin(group, border))
        blocks.append((_rows(text, where[heads[border]], length), own[border], border, doc, flat[mine], group[mine], seed[at], seed[end - 1]))
        at = end

    at = 0
    while at < len(blocks) - 1:  # the blocks from one on that border within its last seed
        end = at + 1
        while end < len(blocks) and blocks[end][6] == blocks[at][7] == blocks[end - 1][7]:
            end += 1
        if end > at + 1:
            own = [np.flatnonzero(x[1] == blocks[at][7]) for x in blocks[at:end]]
            lows = merged([(x[0][k], x[3][x[2][k]]) for x, k in zip(blocks[at:end], own, strict=True)], merged_at)
            for x, k, low in zip(blocks[at:end], own, lows, strict=True):
                x[3][x[2][k]] = low
        at = max(end - 1, at + 1)
    for x in blocks:
        best[x[4]] = x[3][x[5]]
    return [best[s:e] for s, e in zip(base[:-1], base[1:], strict=True)]


_PRESS, _UNPRESS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pressed(text: bytes) -> bytes:
    return _PRESS.compress(text)


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    head = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return _PRESS.compress(head + b"".join(parts))


def _unpack(blob: bytes) -> list[bytes]:
    raw = _UNPRESS.decompress(blob)
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    at, out = 8 * (n + 1), []
    for size in np.frombuffer(raw[8 : 8 * (n + 1)], "<i8").tolist():
        out.append(raw[at : at + size])
        at += size
    return out


def _ranges(h: np.ndarray, n: int) -> np.ndarray:
    """The range of n that a 64-bit hash is in, by its upper half."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(16)


def _ordered(t: pa.Table) -> pa.Table:
    """A part's rows in an order that does not depend on how they were dealt: rows are referred to by number."""
    return t.sort_by([("doc_id", "ascending"), ("sha", "ascending")])


def _texts(t: pa.Table) -> tuple[list[int | None], list[bytes]]:
    return t.column("doc_id").to_pylist(), [_UNPRESS.decompress(z) for z in t.column("z").to_pylist()]


STORE = "part long, doc_id long, n_bytes long, sha string, z binary"


def repeats(docs: DataFrame, length: int = 50, part_bytes: int = 16 << 20, hot: int = 20_000, fan: int = 512, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept_sha256) for each row of doc_id, text: removed are the maximal runs [start, end) of bytes covered by a ``length``-byte string that also starts in a document with a smaller doc_id.

    Texts are UTF-8 bytes, null is empty, and what is removed is judged on the input. Rows that repeat a doc_id are one
    document: they take nothing from each other. A row without a doc_id is kept whole and takes nothing from others.
    An empty table gives no rows, other columns are not read, and texts may have any length.

    1. Texts are dealt by doc_id into parts, compressed and kept; all later steps come to them.
    2. Each window of ``length`` bytes has a seed, its least gram hash. The seeds of a part are counted by range of hash,
       and those met twice anywhere go back to the parts that have them: no other window can repeat. Parts send a
       row for each of at most ``fan`` ranges; of more than ``fan`` parts, the seeds of so many are joined on the way and then go to finer
       ranges, so that rows grow with the parts and not with their square.
    3. The windows of such seeds go, once for each different stretch of text in a part and with its smallest doc_id, to
       the range of their seed, so that equal windows meet. How a seed is dealt depends on its places: with more than ``hot`` of them by the hash of
       each whole window instead, so that one very common string is not one task; the result is the same.
    4. In each range the different stretches, in the order of their seeds, are cut into blocks of ``block`` bytes. Suffix arrays and common
       prefixes give every window the smallest document that has it, and blocks that border within a seed are merged by binary search.
    5. Back in the parts, windows with a smaller document are marked and the rest of each text is hashed.
    """
    spark = ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(24, -(-total // part_bytes))
    # ranges of seeds and of stretches: as many as keep what a task holds small, and 64 unless there are very many parts
    n_fine, n_ranges = max(64, -(-n_parts // 4)), max(64, -(-n_parts // 2))
    n_coarse = min(n_fine, fan)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("part"), b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([_pressed(t) for t in texts], pa.binary())],
                names=["part", "doc_id", "n_bytes", "sha", "z"],
            )

    part = F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)).alias("part")
    n_tasks = max(n_parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = cut_by(docs.select(part, "doc_id", "text").mapInArrow(store, STORE), n_tasks, "part")
    release(spark)

    def by_range(packed: np.ndarray, names: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Sorted seeds (48 bits, and 16 below) cut where the names of their ranges change."""
        if not len(packed):
            return
        cuts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(packed)], strict=True):
            yield int(names[s]), _pack(np.diff(packed[s:e], prepend=np.uint64(0)))

    def unpacked(t: pa.Table, name: str = "blob") -> list[np.ndarray]:
        return [np.cumsum(np.frombuffer(_unpack(b)[0], "<u8"), dtype=np.uint64) for b in t.column(name).to_pylist()]

    def fine(packed: np.ndarray) -> np.ndarray:
        return _ranges(packed, n_fine)

    def coarse(packed: np.ndarray) -> np.ndarray:
        return fine(packed) * n_coarse // n_fine

    def rows_of(**columns) -> pa.Table:
        kinds = {"blob": pa.binary()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()})

    def counted(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(different seeds, how often each is met, for all of the lists which seed it is)."""
        packed = np.concatenate(lists)
        h, inverse = np.unique(packed >> np.uint64(16), return_inverse=True)
        return h, np.bincount(inverse, (packed & np.uint64(65535)).astype(float)), inverse

    def count_seeds(t: pa.Table) -> pa.Table:
        ids, texts = _texts(t)
        h = _short(seeds([x for i, x in zip(ids, texts, strict=True) if i is not None], length)[3])
        h, n = np.unique(h, return_counts=True)
        packed = h << np.uint64(16) | np.minimum(n, 65535).astype(np.uint64)
        rows = list(by_range(packed, coarse(packed)))
        part = t.column("part")[0].as_py()
        return rows_of(part=[part] * len(rows), group=[part // fan] * len(rows), range=[k for k, _ in rows], blob=[b for _, b in rows])

    def joined(t: pa.Table) -> pa.Table:
        """The seeds that a group of parts has in a coarse range, once each, to the fine ranges."""
        h, n, _ = counted(unpacked(t))
        packed = h << np.uint64(16) | np.minimum(n, 65535).astype(np.uint64)
        rows = list(by_range(packed, fine(packed)))
        group, range_ = t.column("group")[0].as_py(), t.column("range")[0].as_py()
        return rows_of(part=[group] * len(rows), range=[range_] * len(rows), fine=[k for k, _ in rows], blob=[b for _, b in rows])

    def shared(t: pa.Table) -> pa.Table:
        """Seeds met twice: back to each part (or group of parts) that has them, with 1 behind those with very many places."""
        lists = unpacked(t)
        h, n, inverse = counted(lists)
        mark = (h << np.uint64(1)) | (n > hot).astype(np.uint64)
        out, at = [], 0
        for p, r, x in zip(t.column("part").to_pylist(), t.column("range").to_pylist(), lists, strict=True):
            k = inverse[at : at + len(x)]
            at += len(x)
            k = k[n[k] > 1]
            if len(k):
                out.append((p, r, _pack(np.diff(mark[k], prepend=np.uint64(0)))))
        return rows_of(part=[p for p, _, _ in out], range=[r for _, r, _ in out], blob=[b for _, _, b in out])

    def routed(own: pa.Table, back: pa.Table) -> pa.Table:
        """What came back to a group of parts, to each part that has it."""
        if not own.num_rows or not back.num_rows:
            return rows_of(part=[], range=[], blob=[])
        marks = np.sort(np.concatenate(unpacked(back)))
        known = marks >> np.uint64(1)
        out = []
        for p, x in zip(own.column("part").to_pylist(), unpacked(own), strict=True):
            h = x >> np.uint64(16)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            k = marks[at[known[at] == h]]
            if len(k):
                out.append((p, _pack(np.diff(k, prepend=np.uint64(0)))))
        return rows_of(part=[p for p, _ in out], range=[0] * len(out), blob=[b for _, b in out])

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        """range -1: the part's own places of shared seeds; other ranges: their different stretches of text."""
        if not left.num_rows or not right.num_rows:
            return pa.table({"part": pa.array([], pa.int64()), "range": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        marks = np.sort(np.concatenate(unpacked(right)))
        known = marks >> np.uint64(1)
        ids, texts = _texts(_ordered(left))
        named = [k for k, i in enumerate(ids) if i is not None]
        doc = np.array([ids[k] for k in named], np.int64)
        texts = [texts[k] for k in named]
        t, first, n, h = seeds(texts, length)
        at = np.minimum(np.searchsorted(known, _short(h)), len(known) - 1)
        ok = known[at] == _short(h)
        t, first, n, h, is_hot = t[ok], first[ok], n[ok], h[ok], (marks[at[ok]] & np.uint64(1)).astype(bool)
        seen: dict[bytes, int] = {}
        lows: list[int] = []
        to: list[int] = []
        subs: list[int] = []
        places: list[tuple[int, int, int, int]] = []
        ranges = _ranges(h, n_ranges).tolist()
        low_bits = (h & np.uint64(0xFFFFFFFF)).astype(np.int64).tolist()
        for a, f, k, r, b, many, d in zip(t.tolist(), first.tolist(), n.tolist(), ranges, low_bits, is_hot.tolist(), doc[t].tolist(), strict=True):
            text = texts[a]
            for s, m in [(f, k)] if not many else [(f + i, 1) for i in range(k)]:
                piece = text[s : s + m - 1 + length]
                i = seen.setdefault(piece, len(seen))
                if i == len(lows):
                    lows.append(d)
                    own = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little") if many else 0
                    to.append((own >> 32) % n_ranges if many else r)
                    subs.append(own & 0xFFFFFFFF if many else b)
                elif d < lows[i]:
                    lows[i] = d
                places.append((a, s, m, i))
        part = left.column("part")[0].as_py()
        p = np.array(places, np.int64).reshape(-1, 4)
        row = np.array(named, np.int64)
        rows = [(-1, _pack(row[p[:, 0]].astype("<i8"), doc[p[:, 0]].astype("<i8"), *(p[:, c].astype("<i8") for c in (1, 2, 3))))]
        pieces, to, lows, subs = list(seen), np.array(to, np.int64), np.array(lows, np.int64), np.array(subs, np.int64)
        order = np.argsort(to, kind="stable")
        for k in np.unique(to).tolist():
            mine = order[np.searchsorted(to[order], k) : np.searchsorted(to[order], k, side="right")]
            these = [pieces[i] for i in mine.tolist()]
            rows.append((k, _pack(mine.astype("<i8"), lows[mine].astype("<i8"), subs[mine].astype("<u4"), np.array([len(x) for x in these], "<i8"), b"".join(these))))
        return pa.table({"part": pa.array([part] * len(rows), pa.int64()), "range": pa.array([k for k, _ in rows], pa.int64()), "blob": pa.array([b for _, b in rows], pa.binary())})

    def judge(t: pa.Table) -> pa.Table:
        """For each part and stretch of text: the smallest document that has all of it, and which windows an even smaller one has."""
        seen: dict[bytes, int] = {}
        lows: list[int] = []
        subs: list[int] = []
        mine = []
        for b in t.column("blob").to_pylist():
            idx, low, sub, size, text = _unpack(b)
            idx, low, size = (np.frombuffer(x, "<i8") for x in (idx, low, size))
            at, which = 0, []
            for d, k, n in zip(low.tolist(), np.frombuffer(sub, "<u4").tolist(), size.tolist(), strict=True):
                piece = text[at : at + n]
                at += n
                i = seen.setdefault(piece, len(seen))
                if i == len(lows):
                    lows.append(d)
                    subs.append(k)
                elif d < lows[i]:
                    lows[i] = d
                which.append(i)
            mine.append((idx, np.array(which, np.int64)))
        pieces, lows = list(seen), np.array(lows, np.int64)
        # what shares no seed shares no window
        order = sorted(range(len(pieces)), key=lambda i: (subs[i], pieces[i]))
        firsts = first_documents([pieces[i] for i in order], lows[order], length, block, np.array(subs, np.int64)[order])
        smaller: list[np.ndarray] = [np.zeros(0, bool)] * len(pieces)
        for i, f in zip(order, firsts, strict=True):
            smaller[i] = f < lows[i]
        rows = []
        for p, (idx, which) in zip(t.column("part").to_pylist(), mine, strict=True):
            bits = [smaller[i] for i in which.tolist()]
            rows.append((p, _pack(idx.astype("<i8"), lows[which].astype("<i8"), np.array([len(x) for x in bits], "<i8"), np.packbits(np.concatenate(bits)).tobytes())))
        return pa.table({"part": pa.array([p for p, _ in rows], pa.int64()), "range": pa.array([0] * len(rows), pa.int64()), "blob": pa.array([b for _, b in rows], pa.binary())})

    def strip(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _ordered(left)
        _, texts = _texts(left)
        shas = left.column("sha").to_pylist()
        place, lows, bits = None, {}, {}
        for r, b in zip(right.column("range").to_pylist(), right.column("blob").to_pylist(), strict=True):
            parts = _unpack(b)
            if r == -1:
                place = [np.frombuffer(x, "<i8") for x in parts]
                continue
            idx, low, size = (np.frombuffer(x, "<i8") for x in parts[:3])
            flat = np.unpackbits(np.frombuffer(parts[3], np.uint8))[: size.sum()].astype(bool)
            lows |= dict(zip(idx.tolist(), low.tolist(), strict=True))
            any_ = np.add.reduceat(flat, np.cumsum(size) - size) > 0 if len(size) else []
            end = np.cumsum(size)
            for i, e, n, some in zip(idx.tolist(), end.tolist(), size.tolist(), any_, strict=True):
                if some:
                    bits[i] = flat[e - n : e]
        runs: dict[int, list[tuple[int, int]]] = {}
        if place is not None:
            for row, d, s, n, i in zip(*(x.tolist() for x in place), strict=True):
                if d > lows[i]:
                    runs.setdefault(row, []).append((s, s + n - 1 + length))
                elif i in bits:
                    runs.setdefault(row, []).extend((s + k, s + k + length) for k in np.flatnonzero(bits[i]).tolist())
        removed, n_removed = [], []
        for k, text in enumerate(texts):
            spans: list[list[int]] = []
            for s, e in sorted(runs.get(k, ())):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(e, spans[-1][1])
                else:
                    spans.append([s, e])
            removed.append([{"start": s, "end": e} for s, e in spans])
            n_removed.append(sum(e - s for s, e in spans))
            if spans:
                at, h = 0, hashlib.sha256()
                for s, e in spans:
                    h.update(text[at:s])
                    at = e
                h.update(text[at:])
                shas[k] = h.hexdigest()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": left.column("doc_id"), "n_bytes": left.column("n_bytes"), "n_removed": pa.array(n_removed, pa.int64()), "removed": pa.array(removed, kind), "kept_sha256": pa.array(shas, pa.string())})

    blob = "part long, range long, blob binary"
    one = "part long, range long, blob binary"
    sent = kept.select("part", "doc_id", "z").groupBy("part").applyInArrow(count_seeds, "part long, group long, range long, blob binary")
    if n_parts <= fan:
        back = sent.select("part", "range", "blob").groupBy("range").applyInArrow(shared, one)
    else:
        sent = cut(sent)
        finer = sent.groupBy("group", "range").applyInArrow(joined, "part long, range long, fine long, blob binary")
        found = finer.groupBy("fine").applyInArrow(shared, one).select(F.col("part").alias("g"), F.col("range").alias("r"), "blob")
        back = sent.groupBy("group", "range").cogroup(found.groupBy("g", "r")).applyInArrow(routed, one)
    back = back.select("part", "blob")
    dealt = cut(kept.select("part", "doc_id", "sha", "z").groupBy("part").cogroup(back.groupBy("part")).applyInArrow(deal, blob))
    release(spark)
    judged = dealt.where("range >= 0").groupBy("range").applyInArrow(judge, blob)
    answers = dealt.where("range = -1").unionByName(judged)
    return kept.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        strip, "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept_sha256 string"
    )


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
