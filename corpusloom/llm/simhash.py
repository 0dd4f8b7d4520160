"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked through a grid on segment popcounts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import Forest, binary, components, cut, spread_join, table

SEED = 42


def fingerprint(text: bytes | None, n: int = 4) -> int:
    """Bit by bit the majority of the XXH64 of all n-word shingles (repeats included); of the whole sequence if it has fewer words; 0 without words."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= n:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = np.concatenate([[0], ends[:-1]])[: len(w) - n + 1].tolist()
    of = xxhash.xxh64_intdigest
    h = np.array([of(joined[s:e], SEED) for s, e in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):  # bits of long texts in pieces
        votes += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp): text_hash is the XXH64 of the text (null as empty), fp the fingerprint's bits as a signed long. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in binary(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


#: Segments of two bits: the embedding has 32 coordinates from 0 to 2.
ODD = 0x5555555555555555


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp):
    """The popcount of each two-bit segment in unary (0: 00, 1: 01, 2: 11), so that XOR and popcount give the Manhattan distance of two embeddings, which is never above the Hamming distance."""
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(ODD))
    low = fp.bitwiseAND(F.lit(ODD))
    return high.bitwiseOR(low).bitwiseOR(F.shiftleft(high.bitwiseAND(low), 1))


def masks(distance: int, groups: int) -> list[int]:
    """Of ``groups`` runs of segments, ``distance`` at most differ between embeddings within that Manhattan distance; so they share the grid cell of some choice of the others."""
    cuts = [round(i * 32 / groups) for i in range(groups + 1)]
    part = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(part[i] for i in c) for c in combinations(range(groups), groups - distance)]


def groups_for(n: int, distance: int) -> int:
    """The number of segment groups that makes least work for n fingerprints: more of them make more rows, of which fewer share a cell. The links are the same for any."""

    def work(g: int) -> float:
        cells = 2.0 ** (1.2 * 32 * (g - distance) / g)  # a segment's popcount has one and a half bits at best, and fingerprints of like texts fewer
        return comb(g, distance) * (100 * n + n * n / cells)

    return min(range(distance + 2, distance + 13), key=work)


def _linked(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell (k, cell, x, y): whole cells are compared together, a row with the next one, the second next and so on, and leave the edges of a forest."""
        held: list[np.ndarray] = []

        def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, fp, emb, rep, side = cols
            n = len(fp)
            f = Forest(n)
            last = np.searchsorted(key, key, side="right") if n else key  # keys are numbered in order
            i = np.arange(n)
            k = 1
            while len(i := i[i + k < last[i]]):
                j = i + k
                ok = np.bitwise_count(emb[i] ^ emb[j]) <= distance
                ok &= (side[i] < 0) | (side[i] != side[j])
                a, z = i[ok], j[ok]
                ok = np.bitwise_count(fp[a] ^ fp[z]) <= distance
                a, z = a[ok], z[ok]
                if len(a):
                    ok = f.up[a] != f.up[z]
                    f.join(a[ok], z[ok])
                    if len(a) > 64:
                        f.roots()
                k += 1
            root = f.roots()
            kept = np.flatnonzero(root != np.arange(n))
            return pa.RecordBatch.from_arrays([pa.array(rep[kept]), pa.array(rep[root[kept]])], names=["a", "b"])

        def columns(b: pa.RecordBatch) -> list[np.ndarray]:
            return [b.column(c).to_numpy() for c in ("k", "cell", "x", "y", "fp", "emb", "rep", "side")]

        def numbered(c: list[np.ndarray]) -> list[np.ndarray]:
            new = np.zeros(len(c[0]), bool)
            for v in c[:4]:
                new[1:] |= v[1:] != v[:-1]
            return [np.cumsum(new), c[4].view(np.uint64), c[5].view(np.uint64), c[6], c[7]]

        for b in batches:
            now = columns(b)
            if not len(now[0]):
                continue
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            same = np.ones(len(held[0]), bool)
            for v in held[:4]:
                same &= v == v[-1]
            whole = len(same) - int(same.sum())  # rows are sorted: the last cell may go on
            if whole:
                yield solve(numbered([v[:whole] for v in held]))
                held = [v[whole:] for v in held]
        if held:
            yield solve(numbered(held))

    return run


def links(reps: DataFrame, distance: int = 4, groups: int | None = None, block: int = 4096) -> DataFrame:
    """Edges (a, b) between representatives that connect what is within ``distance`` bits, for distinct (fp, rep). groups is groups_for() their number, unless given.

    Every pair within the distance shares a cell, and within a cell every pair is compared: first by Manhattan distance
    of embeddings, then by the exact Hamming distance. A cell of more than ``block`` rows is split into chunks whose pairs
    are compared in separate tasks. A cell leaves a forest of its links rather than all of them.
    """
    ship(reps.sparkSession)
    groups = groups or groups_for(reps.count(), distance)
    cells = F.array(*[F.struct(F.lit(i).alias("k"), F.col("emb").bitwiseAND(F.lit(_long(m))).alias("cell")) for i, m in enumerate(masks(distance, groups))])
    placed = reps.select("fp", "rep", embedding(F.col("fp")).alias("emb")).select("fp", "rep", "emb", F.inline(cells))
    sizes = placed.groupBy("k", "cell").count().where("count > 1")
    hot = sizes.where(F.col("count") > block).select("k", "cell", F.ceil(F.col("count") / F.lit(block // 2)).cast("int").alias("chunks"))
    split = placed.join(cut(hot), ["k", "cell"], "left").withColumn("c", F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")))
    pairs = F.when(F.col("c").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = split.select(
        "k", "cell", "fp", "emb", "rep", F.coalesce("c", F.lit(-1)).alias("c"), F.explode(pairs).alias("o")
    ).select(
        "k",
        "cell",
        F.when(F.col("c") < 0, F.lit(0)).otherwise(F.least("c", "o")).alias("x"),
        F.when(F.col("c") < 0, F.lit(0)).otherwise(F.greatest("c", "o")).alias("y"),
        "fp",
        "emb",
        "rep",
        F.when((F.col("c") < 0) | (F.col("c") == F.col("o")), F.lit(-1)).otherwise(F.col("c")).alias("side"),
    )
    return dealt.repartition("k", "cell", "x", "y").sortWithinPartitions("k", "cell", "x", "y").mapInArrow(_linked(distance), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, words: int = 4, groups: int | None = None) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, keeper) for each row: documents whose fingerprints differ in ``distance`` bits or fewer are linked, and component_id is the smallest doc_id reachable.

    Nodes are fingerprints, so that copies, and null and empty texts (fingerprint 0), cost no pairs. Rows that
    repeat a doc_id each get their row. A row with a null doc_id links like any other; component_id is null only if nothing in the component has an id. keeper
    is the hash of the text of the component's first document: that with the smallest doc_id, ids before none, and of these with the smallest hash. An empty table gives no rows; other columns are not read.
    """
    fps = cut(fingerprints(docs, words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    reps = cut(fps.groupBy("fp").agg(first, F.count("*").alias("count")))
    total, n_fps = reps.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    roots = components(links(reps.select("fp", F.col("fp").alias("rep")), distance, groups))
    rooted = reps.join(roots, reps.fp == roots.node, "left").select("fp", "first", "count", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("name"), F.count("*").alias("n"))
    named = spread_join(rooted, names, "root", n_fps, "n", one_task=0, how="inner").select("fp", F.col("name.doc_id").alias("component_id"), F.col("name.text_hash").alias("keeper"), "count")
    return spread_join(fps, named, "fp", total, how="inner").select("doc_id", "text_hash", "fp", "component_id", "keeper")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
