"""Embedding near-dedup: robust-pruned graphs on overlapping cluster shards, their adjacency lists joined into one flat graph, range-expanding greedy search from medoids, audited recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import Forest, components, cut, spread_join, table

#: Vectors of a shard at most; larger ones are split around centres of their own, over the cluster.
SHARD_ROWS = 4096
#: Rows of a shard that one task assigns to new centres, and queries that one task runs in a shard.
TASK_ROWS = 8192
#: Rows of a block where all pairs are compared, because the graph finds too few of them.
BLOCK_ROWS = 32768


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, centres: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The k nearest centres of each row by number, the nearest first; of equally near ones any, as the seed has it."""
    k = min(k, len(centres))
    out = np.empty((len(x), k), np.int64)
    rng = np.random.default_rng(seed)
    for i in range(0, len(x), 4096):
        s = x[i : i + 4096] @ centres.T
        s += 1e-9 * rng.random(s.shape)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[i : i + 4096] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1)
    return out


def candidates(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k most similar rows of each row but itself, best first, and their similarities."""
    k = min(k, len(x) - 1)
    ids, sims = np.empty((len(x), k), np.int64), np.empty((len(x), k))
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        v = np.take_along_axis(s, top, 1)
        order = np.argsort(-v, axis=1, kind="stable")
        ids[i : i + 1024], sims[i : i + 1024] = np.take_along_axis(top, order, 1), np.take_along_axis(v, order, 1)
    return ids, sims


def robust_prune(x: np.ndarray, degree: int = 12, breadth: int = 40, alpha: float = 1.2) -> list[np.ndarray]:
    """Neighbours of each row: from its ``breadth`` most similar rows the best is taken again and again, and rows that are alpha times nearer to it than to the row itself are dropped (Subramanya et al. 2019)."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64) for _ in range(n)]
    ids, sims = candidates(x, breadth)
    out: list[np.ndarray] = []
    for i in range(0, n, 512):
        c, d = ids[i : i + 512], np.sqrt(np.maximum(0, 2 - 2 * sims[i : i + 512]))
        v = x[c]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bkd,bjd->bkj", v, v)))
        alive, taken = np.ones(c.shape, bool), np.zeros(c.shape, bool)
        for k in range(c.shape[1]):
            take = alive[:, k] & (taken.sum(1) < degree)
            taken[:, k] = take
            alive &= ~(take[:, None] & (alpha * between[:, k] <= d))
        out += [row[t] for row, t in zip(c, taken, strict=True)]
    return out


def linked_by(near: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency lists as (start, flat), with each edge both ways."""
    a = np.repeat(np.arange(n), [len(e) for e in near])
    b = np.concatenate(near) if len(a) else np.zeros(0, np.int64)
    key = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.searchsorted(key // max(1, n), np.arange(n + 1)), key % max(1, n)


def search(
    x: np.ndarray, start: np.ndarray, flat: np.ndarray, asked: np.ndarray, entries: list[np.ndarray], least: float, greedy: bool = True, width: int = 24, slack: float = 0.05
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, similarity) of the rows of x that a search for each row of ``asked`` meets within ``least`` less ``slack``.

    From the entries, a query's best unexpanded rows among the ``width`` nearest seen are expanded until none is left (if
    greedy), and then every row in range, until no row in range is unexpanded.
    """
    n = len(x)

    def spread(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = start[v + 1] - start[v]
        at = np.repeat(start[v] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.repeat(q, size), flat[at]

    for a in range(0, len(asked), 256):
        b = min(256, len(asked) - a)
        seen = np.zeros((b, n), bool)
        sim = np.full((b, n), -np.inf)
        done = np.zeros((b, n), bool)

        def visit(q: np.ndarray, v: np.ndarray) -> None:
            key = np.unique(q * n + v)
            q, v = key // n, key % n
            fresh = ~seen[q, v]
            q, v = q[fresh], v[fresh]
            seen[q, v] = True
            for i in range(0, len(q), 65536):
                sim[q[i : i + 65536], v[i : i + 65536]] = np.einsum("id,id->i", asked[a + q[i : i + 65536]], x[v[i : i + 65536]])

        part = entries[a : a + b]
        visit(np.repeat(np.arange(b), [len(e) for e in part]), np.concatenate(part))
        active = np.arange(b) if greedy else np.zeros(0, np.int64)
        while len(active):
            s = sim[active]
            w = min(width, n)
            top = np.argpartition(-s, w - 1, axis=1)[:, :w]
            open_ = seen[active[:, None], top] & ~done[active[:, None], top]
            best = np.where(open_, np.take_along_axis(s, top, 1), -np.inf)
            pick = np.argsort(-best, axis=1)[:, :4]
            ok = np.take_along_axis(best, pick, 1) > -np.inf
            q, v = np.repeat(active, ok.sum(1)), np.take_along_axis(top, pick, 1)[ok]
            done[q, v] = True
            visit(*spread(q, v))
            active = active[ok.any(1)]
        while True:
            q, v = np.nonzero((sim >= least - slack) & ~done)
            if not len(q):
                break
            done[q, v] = True
            visit(*spread(q, v))
        q, v = np.nonzero(sim >= least - slack)
        yield a + q, v, sim[q, v]


def _vectors(b: pa.RecordBatch | pa.Table, name: str = "vec") -> np.ndarray:
    col = b.column(name).combine_chunks() if isinstance(b, pa.Table) else b.column(name)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def build_shard(t: pa.Table) -> pa.Table:
    """Edges (a, b, sim) of one shard's robust-pruned graph, both ways. Candidates come from the shard's own rows; pairs of different shards are found through vectors that both have."""
    ids = t.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], unit(_vectors(t)[order])
    start, flat = linked_by(robust_prune(x), len(x))
    a = np.repeat(np.arange(len(x)), np.diff(start))
    sim = np.concatenate([np.einsum("id,id->i", x[a[i : i + 65536]], x[flat[i : i + 65536]]) for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
    return pa.table({"a": ids[a], "b": ids[flat], "sim": pa.array(sim.astype(np.float32))})


#: Of what a query has met in a shard, the nearest rows from which it goes on into other shards; and where it begins there, at most. They bound where a search begins, not what it finds.
FROM, ENTRIES = 64, 16
STEP = "id long, shard long, other long, n long"


def _ranks(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The rank of each row within its group, by key."""
    order = np.lexsort((key, group))
    g, at = group[order], np.arange(len(group))
    new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    out = np.empty(len(g), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0)) if len(g) else at
    return out


class _Part:
    """The residents of one shard in the flat graph: rows, the edges between them, and the edges to residents of other shards."""

    def __init__(self, t: pa.Table):
        ids = t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.count, self.x = ids[order], t.column("count").to_numpy()[order], unit(_vectors(t)[order])
        self.shard = t.column("shard")[0].as_py()
        near = t.column("near").combine_chunks()
        at, edge = near.offsets.to_numpy(), near.values
        owner = np.repeat(np.argsort(order), np.diff(at))  # the row, by place after sorting, of each edge
        other, home, sim = (edge.field(c).to_numpy(zero_copy_only=False) for c in ("id", "home", "sim"))
        other, home, sim = (v[at[0] : at[-1]] for v in (other, home, sim))
        inside = home == self.shard
        n = len(self.ids)
        place = np.searchsorted(self.ids, other[inside])
        by = np.argsort(owner[inside], kind="stable")
        self.flat, self.start = place[by], np.searchsorted(owner[inside][by], np.arange(n + 1))
        out = np.flatnonzero(~inside)
        out = out[np.argsort(owner[out], kind="stable")]
        self.out_other, self.out_home, self.out_angle = other[out], home[out], np.arccos(np.clip(sim[out].astype(float), -1, 1))
        self.out_start = np.searchsorted(owner[out], np.arange(n + 1))
        self.medoid = int(np.argmax(self.x @ self.x.mean(0)))

    def run(self, ids: np.ndarray, asked: np.ndarray, entries: list[np.ndarray], least: float, greedy: bool) -> pa.Table:
        """Rows of STEP: what each query has found here (n), a forest of the links (other, no shard), and where it goes on (shard and other)."""
        total, f = np.zeros(len(ids), np.int64), Forest(len(self.ids) + len(ids))
        far = np.arccos(least) + 1e-4
        more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for q, v, s in search(self.x, self.start, self.flat, asked, entries, least, greedy):
            linked_, other = s >= least, ids[q] != self.ids[v]
            np.add.at(total, q[linked_ & other], self.count[v[linked_ & other]])
            a, b = len(self.ids) + q[linked_], v[linked_]
            root = f.roots()
            apart = root[a] != root[b]
            f.join(a[apart], b[apart])
            keep = _ranks(q, -s) < FROM
            q, v, s = q[keep], v[keep], s[keep]
            size = self.out_start[v + 1] - self.out_start[v]
            at = np.repeat(self.out_start[v] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            q, home, other = np.repeat(q, size), self.out_home[at], self.out_other[at]
            bound = self.out_angle[at] - np.arccos(np.clip(np.repeat(s, size), -1, 1))  # no nearer can the next one be
            keep = bound <= far
            q, home, other, bound = q[keep], home[keep], other[keep], bound[keep]
            keep = _ranks(np.unique(np.stack([q, home]), axis=1, return_inverse=True)[1], bound) < ENTRIES if len(q) else np.zeros(0, bool)
            more.append((q[keep], home[keep], other[keep]))
        names = np.concatenate([self.ids, ids])
        root = f.roots()
        kept = np.flatnonzero(root != np.arange(len(root)))
        some = np.flatnonzero(total)
        q, home, other = (np.concatenate(c) for c in zip(*more, strict=True)) if more else (np.zeros(0, np.int64),) * 3
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table(
            {
                "id": pa.array(np.concatenate([ids[some], names[kept], ids[q]])),
                "shard": pa.concat_arrays([none(len(some) + len(kept)), pa.array(home)]),
                "other": pa.concat_arrays([none(len(some)), pa.array(names[root[kept]]), pa.array(other)]),
                "n": pa.concat_arrays([pa.array(total[some]), none(len(kept) + len(q))]),
            }
        )


def search_home(t: pa.Table, least: float) -> pa.Table:
    """A search for each resident of a shard, from the shard's medoid and from its own place in the graph."""
    p = _Part(t)
    return p.run(p.ids, p.x, [np.array([p.medoid, i]) for i in range(len(p.ids))], least, True)


def search_on(residents: pa.Table, asked: pa.Table, least: float) -> pa.Table:
    """Searches that come from other shards, from the neighbours they know here."""
    if not residents.num_rows or not asked.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("id", "shard", "other", "n")})
    p = _Part(residents)
    order = np.argsort(asked.column("q").to_numpy(), kind="stable")
    lists = asked.column("entries").to_pylist()
    entries = [np.unique(np.searchsorted(p.ids, np.array(lists[i], np.int64))) for i in order.tolist()]
    return p.run(asked.column("q").to_numpy()[order], unit(_vectors(asked, "qvec")[order]), entries, least, False)


def compare(t: pa.Table, least: float) -> pa.Table:
    """What search_shard() gives, of all pairs of one pair of blocks (columns i and j), compared one by one."""
    ids, count, block = (t.column(c).to_numpy() for c in ("id", "count", "block"))
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    vecs = t.column("vec").to_pylist()
    order = np.argsort(ids, kind="stable")
    f, n = Forest(len(ids)), np.zeros(len(ids), np.int64)
    sizes = np.array([len(v) for v in vecs])
    for d in np.unique(sizes):
        left, right = (order[(sizes[order] == d) & (block[order] == k)] for k in (i, j))
        if not len(left) or not len(right):
            continue
        x, y = (unit(np.array([vecs[k] for k in side], float)) for side in (left, right))
        for a in range(0, len(left), 256):
            s = x[a : a + 256] @ y.T
            ok = s >= least
            p, q = np.nonzero(np.abs(s - least) <= 1e-9)
            ok[p, q] = np.einsum("id,id->i", x[a + p], y[q]) >= least
            if i == j:
                ok &= np.arange(len(right)) > np.arange(a, a + len(s))[:, None]
            rows = left[a : a + 256]
            np.add.at(n, rows, ok @ count[right])
            np.add.at(n, right, count[rows] @ ok)
            root = f.roots()
            for k in np.flatnonzero(ok.any(1)):
                others = np.unique(root[right[ok[k]]])
                f.join(np.full(len(others), rows[k]), others)
                if len(others) > 64:
                    root = f.roots()
    name = np.full(len(ids), np.iinfo(np.int64).max)
    root = f.roots()
    np.minimum.at(name, root, ids)
    some, kept = np.flatnonzero(n), np.flatnonzero(name[root] != ids)
    none = lambda k: pa.nulls(k, pa.int64())
    return pa.table(
        {"id": pa.array(np.concatenate([ids[some], ids[kept]])), "other": pa.concat_arrays([none(len(some)), pa.array(name[root[kept]])]), "n": pa.concat_arrays([pa.array(n[some]), none(len(kept))])}
    )


def _compare_all(nodes: DataFrame, total: int, least: float) -> DataFrame:
    """All links, by comparing every pair of nodes in pairs of blocks: exact, and quadratic in time."""
    blocks = max(1, -(-total // BLOCK_ROWS))
    b = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int")
    dealt = nodes.select("id", "count", "vec", b.alias("block")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("id", "count", "vec", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    return cut(dealt.groupBy("i", "j").applyInArrow(lambda t: compare(t, least), "id long, other long, n long"))


def _usable():
    v = F.col("vec")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def _sizes(vectors: DataFrame) -> DataFrame:
    """(id, vec, count) of each different usable vector: id is the smallest vec_id that has it, count the rows."""
    return vectors.where(_usable()).groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("count")).where("id IS NOT NULL")


def linked(vectors: DataFrame, least: float = 0.95, overlap: int = 3, audit: int = 256, recall: float = 0.9, most_overlap: int = 24) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vec_id, embedding: others with a cosine of ``least`` or more, and the smallest vec_id reachable by such links.

    Equal vectors are one node. Nodes are dealt to the shards of their ``overlap`` nearest centres, until no shard has more
    than SHARD_ROWS of them; each shard gives a robust-pruned graph, and a node's lists from all its shards make one flat graph. Every node is
    then searched for: in the shard of its nearest centre from that shard's medoid and its own place, and, along edges that
    may lead to links, on into other shards. What is met is compared in double precision.

    The links of ``audit`` nodes or more, drawn whatever was found, are counted by brute force against all nodes; if the
    search has found less than ``recall`` of them, by links or by nodes, the graph is built again with twice the overlap, up to
    most_overlap; if that is still short, all pairs of vectors are compared, block by block. So recall is ``recall`` by
    measurement, or all.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, not even their like, and
    name their own component. Vectors of different length link with nothing of another length. Rows that repeat each get a
    row and count as links of each other; a null vec_id names no component. An empty table gives no rows; other columns are not read.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    nodes = cut(_sizes(rows))
    total, n_rows = nodes.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    while True:
        found = _search_all(nodes, least, overlap)
        counted = found.where("n IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n"))
        if not total or _recall(nodes, counted, total, least, audit) >= recall:
            break
        if overlap >= most_overlap:
            found = _compare_all(nodes, total, least)
            counted = found.where("n IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n"))
            break
        overlap *= 2
    roots = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = nodes.join(counted, "id", "left").join(roots, nodes.id == roots.node, "left")
    key = lambda v: F.struct(F.xxhash64(v), F.xxhash64(v, F.lit(1)))
    named = named.select(key("vec").alias("key"), "count", (F.col("count") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    usable = rows.select("id", F.when(_usable(), key("vec")).alias("key"))
    return spread_join(usable, named, "key", n_rows).select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def deal(nodes: DataFrame, overlap: int, levels: int = 12) -> DataFrame:
    """(shard, home, id, count, vec): each node in some shards of at most SHARD_ROWS rows or so, and at home in one of them.

    The shards of vectors of a length are split, again and again: some of a shard's rows, by a hash, are centres, and
    each row goes to the nearest ones (``overlap`` at first, two later). No task holds a shard; it is assigned in parts of TASK_ROWS. What centres
    do not divide in so many levels is dealt at random.
    """
    live = cut(nodes.select(F.xxhash64(F.size("vec")).alias("shard"), F.lit(True).alias("home"), "id", "count", "vec"))
    done: list[DataFrame] = []
    for level in range(levels + 1):
        big = cut(live.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ROWS))
        if not big.count():
            break
        done.append(live.join(big, "shard", "left_anti"))
        members = live.join(big, "shard")
        if level == levels:
            dealt = F.xxhash64("shard", F.pmod(F.xxhash64("id", F.lit("rest")), F.ceil(F.col("n") / F.lit(SHARD_ROWS))))
            return _union([*done, members.select(dealt.alias("shard"), "home", "id", "count", "vec")])
        parts = F.ceil(F.col("n") / F.lit(TASK_ROWS)).cast("int")
        k = F.least(F.lit(256), F.ceil(F.col("n") * 4 / F.lit(SHARD_ROWS)))
        centres = members.where(F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) < k / F.col("n") * (1 << 30)).select(F.col("shard").alias("of"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("of_part"), F.col("id").alias("centre"), F.col("vec").alias("at"))
        keyed = members.select("shard", F.pmod(F.xxhash64("id", F.lit("part")), parts).cast("int").alias("part"), "home", "id", "count", "vec")
        near = overlap if level == 0 else min(2, overlap)

        def assign(left: pa.Table, right: pa.Table) -> pa.Table:  # run within this round of the loop
            if not left.num_rows or not right.num_rows:  # no centre was drawn: as it is, until the next level
                return left.select(["shard", "home", "id", "count", "vec"]) if left.num_rows else _NODES.empty_table()
            left, right = left.sort_by("id"), right.sort_by("centre")
            shard = left.column("shard")[0].as_py()
            to = nearest(unit(_vectors(left)), unit(_vectors(right, "at")), near, abs(shard) ^ level)
            with np.errstate(over="ignore"):
                name = (np.uint64(shard & (1 << 64) - 1) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.column("centre").to_numpy().astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(level + 1))
            at = np.repeat(np.arange(len(to)), to.shape[1])
            home = np.zeros(to.shape, bool)
            home[:, 0] = left.column("home").to_numpy()
            rest = left.take(pa.array(at))
            return pa.table({"shard": pa.array(name[to.ravel()].view(np.int64)), "home": pa.array(home.ravel()), "id": rest.column("id"), "count": rest.column("count"), "vec": rest.column("vec")})

        live = cut(keyed.groupBy("shard", "part").cogroup(centres.groupBy("of", "of_part")).applyInArrow(assign, "shard long, home boolean, id long, count long, vec array<double>"))
    return _union([*done, live])


_NODES = pa.schema([("shard", pa.int64()), ("home", pa.bool_()), ("id", pa.int64()), ("count", pa.int64()), ("vec", pa.list_(pa.float64()))])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _search_all(nodes: DataFrame, least: float, overlap: int) -> DataFrame:
    """(id, other, n): links counted from each node in one shard (n), and the edges of a forest of them (other)."""
    placed = cut(deal(nodes, overlap))
    edges = placed.select("shard", "id", "vec").groupBy("shard").applyInArrow(build_shard, "a long, b long, sim float")
    homes = placed.where("home").select("id", "shard", "count", "vec")
    to = homes.select(F.col("id").alias("b"), F.col("shard").alias("home"))
    union = edges.join(to, "b").groupBy("a").agg(F.collect_set(F.struct(F.col("b").alias("id"), "home", "sim")).alias("near"))
    kind = "array<struct<id:bigint,home:bigint,sim:float>>"
    graph = cut(homes.join(union, homes.id == union.a, "left").select("shard", "id", "count", "vec", F.coalesce("near", F.array().cast(kind)).alias("near")))
    found = cut(graph.groupBy("shard").applyInArrow(lambda t: search_home(t, least), STEP))
    steps, asked = [found], graph.select(F.col("shard").alias("in_shard"), F.col("id").alias("by"))
    while True:
        # a query is run once in a shard, so what it finds there is counted once
        ask = found.where("shard IS NOT NULL").groupBy("shard", F.col("id").alias("q")).agg(F.collect_set("other").alias("entries"))
        ask = cut(ask.join(asked, (ask["shard"] == asked["in_shard"]) & (ask["q"] == asked["by"]), "left_anti"))
        load = ask.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(TASK_ROWS)).cast("int").alias("parts"))
        if not ask.take(1):
            break
        asked = asked.union(ask.select("shard", "q"))
        asks = ask.join(load, "shard").join(nodes.select(F.col("id").alias("q"), F.col("vec").alias("qvec")), "q")
        asks = asks.select(F.col("shard").alias("of"), F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("of_part"), "q", "qvec", "entries")
        there = graph.join(load, "shard").select("shard", "id", "count", "vec", "near", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        found = cut(there.groupBy("shard", "part").cogroup(asks.groupBy("of", "of_part")).applyInArrow(lambda a, b: search_on(a, b, least), STEP))
        steps.append(found)
    return _union(steps).where("shard IS NULL").select("id", "other", "n")


def _recall(nodes: DataFrame, counted: DataFrame, total: int, least: float, audit: int, enough: int = 200, most: int = 16_384) -> float:
    """The share of the true links of nodes drawn by a hash, whatever was found, that were found: over links or over nodes with links, whichever is less.

    More nodes are drawn until they have ``enough`` links, up to ``most`` nodes (whose vectors are what is sent to the executors).
    """
    while True:
        share = min(1.0, audit / max(1, total))
        drawn = F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(1 << 30))
        asked = nodes.where(drawn < F.lit(int(share * (1 << 30)) + 1)).orderBy(drawn, "id").select("id", "vec").limit(2 * most).toArrow()
        ids, vecs = asked.column("id").to_numpy(), asked.column("vec").combine_chunks()
        sizes, flat = vecs.value_lengths().to_numpy(), vecs.flatten().to_numpy().astype(float, copy=False)
        starts = np.cumsum(sizes) - sizes
        ready = {int(d): (ids[at := np.flatnonzero(sizes == d)], unit(flat[starts[at][:, None] + np.arange(d)])) for d in np.unique(sizes)}
        shared = nodes.sparkSession.sparkContext.broadcast(ready)  # once for an executor: 2 * most vectors at most

        def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n: dict[int, int] = {}
            for b in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
                vecs, count, own = b.column("vec").to_pylist(), b.column("count").to_numpy(), b.column("id").to_numpy()
                size = np.array([len(v) for v in vecs])
                for d, (i, q) in shared.value.items():
                    at = np.flatnonzero(size == d)
                    if len(at):
                        s = unit(np.array([vecs[k] for k in at], float)) @ q.T >= least
                        s &= own[at][:, None] != i[None, :]
                        for k, v in zip(i.tolist(), (count[at] @ s).tolist(), strict=True):
                            if v:
                                n[k] = n.get(k, 0) + v
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.int64()), pa.array(n.values(), pa.int64())], names=["id", "n"])

        true = dict(map(tuple, nodes.select("id", "vec", "count").mapInArrow(brute, "id long, n long").groupBy("id").agg(F.sum("n")).collect()))
        if sum(true.values()) >= enough or audit >= min(most, total):
            break
        audit *= 8
    wanted = nodes.sparkSession.createDataFrame([(i,) for i in true], "id long")
    got = dict(map(tuple, counted.join(F.broadcast(wanted), "id").select("id", "n").collect()))
    if not true:
        return 1.0
    shares = [min(got.get(i, 0), n) / n for i, n in true.items()]
    return min(sum(min(got.get(i, 0), n) for i, n in true.items()) / sum(true.values()), sum(shares) / len(shares))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
