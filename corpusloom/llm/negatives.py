"""Hard-negative mining: an exact kNN join of anchors with all rows, dealt by Voronoi cells of norm-augmented vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, table, written

#: Inner products of vectors up to this squared length are exact longs.
MOST_NORM = float(1 << 62)
#: Label classes by which the driver holds bounds; a class has the loosest bound of its labels.
CLASSES = 64
_PACKED = "vec_id long, label long, norm long, width int, vec binary, anchor boolean"
_NAMES = ["vec_id", "label", "norm", "width", "vec", "anchor"]


def _pack(v: np.ndarray) -> bytes:
    """Integers in as few bytes each as hold them all."""
    top = max(-int(v.min()) - 1, int(v.max())) if len(v) else 0
    return v.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8").tobytes()


def _matrix(vecs: list[bytes], widths: list[int], dim: int) -> np.ndarray:
    """Packed vectors as rows of longs, with zeros behind shorter ones."""
    out = np.zeros((len(vecs), dim), np.int64)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (v, w) in enumerate(zip(vecs, widths, strict=True)):
        if w:
            kinds.setdefault((w, len(v) // w), []).append(i)
    for (w, size), at in kinds.items():
        out[at, :w] = np.frombuffer(b"".join(vecs[i] for i in at), f"<i{size}").reshape(len(at), w)
    return out


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of longs: in doubles where no partial sum can leave their integers, else in longs, whose wrapped sums end right."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0)) * a.shape[1]
    if top < 1 << 53:
        return (a.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return a @ c.T


@dataclass
class Cells:
    """Pivots, and where augmented vectors lie among them.

    A row x becomes (x, sqrt(m^2 - |x|^2)), all of length m, the greatest of the table; an anchor a becomes (a m / |a|, 0). Then a row's inner
    product with an anchor falls as its distance grows: distance^2 = |anchor|^2 + m^2 - 2 scale product, with scale = m / |a|.
    """

    dim: int
    m: float
    pivots: np.ndarray
    tail: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.slack = 1e-6 * self.m + 1e-9
        self.tail = np.sqrt(np.maximum(0, self.m**2 - np.einsum("ij,ij->i", self.pivots, self.pivots)))

    def rows(self, v: np.ndarray) -> np.ndarray:
        """Distances of rows to all pivots."""
        x = v.astype(np.float64)
        tail = np.sqrt(np.maximum(0, self.m**2 - np.einsum("ij,ij->i", x, x)))
        return np.sqrt(np.maximum(0, 2 * self.m**2 - 2 * (x @ self.pivots.T + tail[:, None] * self.tail)))

    def scale(self, v: np.ndarray) -> np.ndarray:
        n = np.sqrt(np.einsum("ij,ij->i", v, v))
        return np.divide(self.m, n, out=np.zeros(len(n)), where=n > 0)

    def anchors(self, v: np.ndarray) -> np.ndarray:
        """Distances of anchors to all pivots; an anchor of zeros lies at the origin, as far from all."""
        q = v.astype(np.float64)
        q *= self.scale(q)[:, None]
        return np.sqrt(np.maximum(0, np.einsum("ij,ij->i", q, q)[:, None] + self.m**2 - 2 * q @ self.pivots.T))


def packed(rows: DataFrame, anchor: Column) -> DataFrame:
    """vec_id, label and vector (integers) in narrow form, with a mark for anchors. Rows without id, label or vector, with a null component, or of a squared length beyond MOST_NORM take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column("vector")
            at, flat = vecs.offsets.to_numpy(), vecs.values.to_numpy()
            each = [flat[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            norm = pa.array([int(v @ v) for v in each], pa.int64())
            width = pa.array([len(v) for v in each], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), norm, width, pa.array(list(map(_pack, each)), pa.binary()), b.column("anchor")], names=_NAMES)

    ship(rows.sparkSession)
    v = F.col("vector")
    length = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).where(F.forall(v, lambda x: x.isNotNull())).where(length < MOST_NORM)
    kept = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.cast("array<long>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    return kept.mapInArrow(run, _PACKED)


def _cells(rows: DataFrame, most: int) -> tuple[Cells, int]:
    """Pivots drawn by a hash of vec_id and vector: some sqrt(rows) / 4, ``most`` at most."""
    n, m, dim = rows.agg(F.count("*"), F.max("norm"), F.max("width")).first()
    some = rows.orderBy(F.xxhash64("vec_id", "vec"), "vec_id", "vec").limit(min(most, 1 + int(n**0.5) // 4)).collect()
    v = np.unique(_matrix([bytes(r.vec) for r in some], [r.width for r in some], dim or 0), axis=0) if some else np.zeros((0, 0))
    return Cells(dim or 0, float(m or 0) ** 0.5, v.astype(np.float64)), n


def _groups(sizes: dict[int, int], cells: Cells, most: int) -> dict[int, tuple[int, int]]:
    """Of each cell that has anchors: its first group and how many it has. Large cells are split, small ones join their nearest up to ``most`` anchors."""
    p, tail = cells.pivots, cells.tail
    out: dict[int, tuple[int, int]] = {}
    n, left = 0, dict(sorted(sizes.items()))
    while left:
        i = max(left, key=lambda c: (left[c], -c))
        k = -(-left[i] // most)
        if k > 1:
            out[i] = (n, k)
            del left[i]
        else:
            room = most
            near = np.square(p - p[i]).sum(axis=1) + np.square(tail - tail[i])
            for c in sorted(left, key=lambda c: (near[c], c)):
                if left[c] <= room:
                    room -= left[c]
                    out[c] = (n, 1)
                    del left[c]
        n += k
    return out


def _reach(stats: DataFrame, anchors: DataFrame, cells: Cells, k: int) -> np.ndarray:
    """(label class, cell): no row of an anchor's first k of its label lies farther from the cell's pivot; NaN where no anchor is.

    Of each cell the k + 1 nearest rows of the label to its pivot (one may be the anchor) bound the distance of an anchor's k-th: anchor to its
    pivot, pivot to pivot, pivot to row.
    """
    between = np.sqrt(np.maximum(0, np.square(cells.pivots[:, None] - cells.pivots[None]).sum(axis=2) + np.square(cells.tail[:, None] - cells.tail[None])))

    def bound(near: pa.Table, far: pa.Table) -> pa.Table:
        cell, most = far.column("cell").to_numpy(), far.column("most").to_numpy()
        label = far.column("label")[0].as_py() if len(cell) else 0
        j, d = near.column("cell").to_numpy(), near.column("dist").to_numpy()
        if len(d) > k:
            theta = np.partition(between[cell][:, j] + d, k, axis=1)[:, k] + most
        else:
            theta = np.full(len(cell), np.inf)
        return pa.table({"class": pa.array(np.full(len(cell), label % CLASSES), pa.int32()), "cell": pa.array(cell, pa.int32()), "reach": pa.array(theta + most)})

    by = stats.groupBy("label").cogroup(anchors.groupBy("label", "cell").agg(F.max("dist").alias("most")).groupBy("label"))
    rows = by.applyInArrow(bound, "class int, cell int, reach double").groupBy("class", "cell").agg(F.max("reach").alias("reach")).collect()  # CLASSES times the pivots at most
    out = np.full((CLASSES, len(cells.pivots)), np.nan)
    for r in rows:
        out[r["class"], r["cell"]] = r["reach"]
    return out


_DEALT = "group int, chunk int, vec_id long, label long, width int, vec binary, hash long"


def _dealt(rows: DataFrame, cells: Cells, groups: dict[int, tuple[int, int]], chunks: int, serves) -> DataFrame:
    """Rows once for each group of anchors they may serve: serves(labels, distances to pivots of cells with anchors, those cells) says so by cell."""
    own = np.array(sorted(groups), np.int64)
    first, count = (np.array([groups[c][k] for c in own.tolist()], np.int64) for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, 4096) for b in batches for k in range(0, b.num_rows, 4096)):
            d = cells.rows(_matrix(b.column("vec").to_pylist(), b.column("width").to_pylist(), cells.dim))
            hit = serves(b.column("label").to_numpy(), d[:, own], own)
            row, at = np.nonzero(hit)
            times = count[at]
            of = np.repeat(first[at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            pair = np.unique(np.stack([np.repeat(row, times), of]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
            for s in range(0, pair.shape[1], 8192):
                r, g = pair[:, s : s + 8192]
                part = b.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), part.column("chunk"), *[part.column(c) for c in ("vec_id", "label", "width", "vec", "hash")]], names=[x.split()[0] for x in _DEALT.split(", ")])

    hashed = rows.select("vec_id", "label", "width", "vec", F.xxhash64("vec_id", "label", "width", "vec").alias("hash"))
    return hashed.withColumn("chunk", F.pmod("hash", F.lit(chunks)).cast("int")).mapInArrow(run, _DEALT)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, of equal ones the smallest ids first."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _joined(anchors: DataFrame, dealt: DataFrame, chunks: int, dim: int, pick, schema: str) -> DataFrame:
    """Each chunk of a group's rows, equal ones once, with the group's anchors: pick(anchor as a dict, scores, ids, labels, hashes) gives tuples behind its (anchor_id, anchor_hash)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            right = right.group_by(["vec_id", "label", "width", "vec", "hash"]).aggregate([])
            ids, labels, hashes = (right.column(x).to_numpy() for x in ("vec_id", "label", "hash"))
            c = _matrix(right.column("vec").to_pylist(), right.column("width").to_pylist(), dim)
            a = left.to_pylist()
            for s in range(0, len(a), 64):
                some = a[s : s + 64]
                scores = products(_matrix([r["vec"] for r in some], [r["width"] for r in some], dim), c)
                for r, score in zip(some, scores, strict=True):
                    out += [(r["vec_id"], r["anchor_hash"], *x) for x in pick(r, score, ids, labels, hashes)]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * len(names))], names=names)

    each = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return each.groupBy("group", "chunk").cogroup(dealt.groupBy("group", "chunk")).applyInArrow(run, schema)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, pivots: int = 256, group_anchors: int = 256, chunk_rows: int = 4096) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, label, vector of integers); anchor marks the anchors.

    A score is the inner product with the anchor; higher ones come first, of equal ones the smaller vec_id. Positives are an anchor's first rows of its
    label with another vec_id, and of each the first rows of other labels whose score is from ``low`` to ``high`` hundredths of the positive's are its negatives.

    Rows lie in the cells of pivots, anchors of near cells form groups (group_anchors each, larger cells are split), and a row goes to the groups
    whose bounds it meets: for positives within the distance that the cells' nearest rows prove, for negatives within the distances that the anchors'
    scores allow. What a group gets is dealt into chunks, joined exactly, and the chunks' firsts are merged; so neither a label nor a
    cell nor a group is one task's. Nothing is approximate. The driver holds pivots (a sample of ``pivots`` rows at most) and bounds by cell and label class.

    Rows that repeat wholly count once; those that repeat a vec_id with another label or vector each count, and are other rows to all but each other. Shorter vectors
    count as if zeros followed. See packed() for rows that take no part. An anchor without a positive or negative has no row; an empty table gives none.
    """
    held = written(packed(rows, anchor))
    cells, n = _cells(held, pivots)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = rows.sparkSession
    if not len(cells.pivots):
        return spark.createDataFrame([], out)
    chunks = max(1, -(-n // chunk_rows))

    def placed(of_anchors: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b.slice(k, 4096) for b in batches for k in range(0, b.num_rows, 4096)):
                v = _matrix(b.column("vec").to_pylist(), b.column("width").to_pylist(), cells.dim)
                d = cells.anchors(v) if of_anchors else cells.rows(v)
                cell = np.argmin(d, axis=1)
                place = [pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])]
                if of_anchors:
                    yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("vec_id", "label", "width", "vec")], *place], names=["vec_id", "label", "width", "vec", "cell", "dist"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), *place], names=["vec_id", "label", "cell", "dist"])

        return run

    different = held.where("anchor").select("vec_id", "label", "width", "vec").distinct()
    at = cut(different.mapInArrow(placed(True), "vec_id long, label long, width int, vec binary, cell int, dist double").withColumn("anchor_hash", F.xxhash64("label", "vec")))
    groups = _groups({r["cell"]: r["count"] for r in at.groupBy("cell").count().collect()}, cells, group_anchors)  # a row a pivot
    if not groups:
        return spark.createDataFrame([], out)
    which = F.from_json(F.lit("[" + ",".join(f'{{"f":{f},"k":{k}}}' for f, k in (groups.get(c, (0, 1)) for c in range(len(cells.pivots)))) + "]"), "array<struct<f:int,k:int>>")
    own = F.get(which, F.col("cell"))
    at = at.withColumn("group", own["f"] + F.pmod(F.xxhash64("vec_id", "anchor_hash"), own["k"].cast("long")).cast("int"))

    near = held.select("vec_id", "label", "width", "vec").mapInArrow(placed(False), "vec_id long, label long, cell int, dist double")
    near = near.groupBy("cell", "label", "vec_id").agg(F.min("dist").alias("dist"))
    near = near.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    for keys in (("cell", "label", "salt"), ("cell", "label")):  # a cell's rows of a label are first thinned out in 16 tasks
        near = near.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("dist", "vec_id"))).where(F.col("r") <= positives + 1)
    reach = _reach(near.select("label", "cell", "dist"), at.select("label", "cell", "dist"), cells, positives)

    def same(labels: np.ndarray, d: np.ndarray, own: np.ndarray) -> np.ndarray:
        return d <= reach[labels % CLASSES][:, own] + cells.slack

    def first_of_label(r: dict, score: np.ndarray, ids: np.ndarray, labels: np.ndarray, hashes: np.ndarray) -> Iterator[tuple]:
        mine = np.flatnonzero((labels == r["label"]) & (ids != r["vec_id"]))
        mine = mine[_first(score[mine], ids[mine], positives)]
        return zip(ids[mine].tolist(), score[mine].tolist(), hashes[mine].tolist(), strict=True)

    found = _joined(at, _dealt(held, cells, groups, chunks, same), chunks, cells.dim, first_of_label, "anchor_id long, anchor_hash long, positive_id long, positive_score long, positive_hash long")
    order = Window.partitionBy("anchor_id", "anchor_hash").orderBy(F.desc("positive_score"), "positive_id", "positive_hash")
    top = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)
    with_band = top.where("positive_score >= 0").groupBy("anchor_id", "anchor_hash").agg(F.collect_list(F.struct("positive_id", "positive_score", "positive_hash")).alias("positives"))  # a few each
    more = cut(at.join(with_band, (F.col("anchor_id") == at["vec_id"]) & (with_band["anchor_hash"] == at["anchor_hash"])).select(*[at[c] for c in at.columns], "positives"))

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("vec").to_pylist(), b.column("width").to_pylist(), cells.dim).astype(np.float64)
            scores = b.column("positives").to_pylist()
            scale = cells.scale(v)
            base = np.where(scale > 0, 2 * cells.m**2, cells.m**2)
            far = np.sqrt(np.maximum(0, base - 2 * scale * low / 100 * np.array([min(p["positive_score"] for p in s) for s in scores], np.float64)))
            close = np.sqrt(np.maximum(0, base - 2 * scale * high / 100 * np.array([max(p["positive_score"] for p in s) for s in scores], np.float64)))
            yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("dist"), pa.array(close), pa.array(far)], names=["cell", "dist", "close", "far"])

    bands = more.select("cell", "dist", "width", "vec", "positives").mapInArrow(banded, "cell int, dist double, close double, far double")
    at_cell = np.full((3, len(cells.pivots)), np.nan)
    for r in bands.groupBy("cell").agg(F.max("dist"), F.min("close"), F.max("far")).collect():  # a row a pivot
        at_cell[:, r[0]] = r[1:]

    def within(labels: np.ndarray, d: np.ndarray, own: np.ndarray) -> np.ndarray:
        most, close, far = at_cell[:, own]
        return (d - most <= far + cells.slack) & (d + most >= close - cells.slack)

    def first_of_band(r: dict, score: np.ndarray, ids: np.ndarray, labels: np.ndarray, hashes: np.ndarray) -> Iterator[tuple]:
        others = (labels != r["label"]) & (ids != r["vec_id"])
        for p in r["positives"]:
            best = p["positive_score"]
            least, most = -(-low * best // 100), high * best // 100
            mine = np.flatnonzero(others & (score >= least) & (score <= most))
            for i in mine[_first(score[mine], ids[mine], negatives)].tolist():
                yield p["positive_id"], best, p["positive_hash"], int(ids[i]), int(score[i]), int(hashes[i])

    pairs = _joined(more, _dealt(held, cells, groups, chunks, within), chunks, cells.dim, first_of_band, "anchor_id long, anchor_hash long, positive_id long, positive_score long, positive_hash long, negative_id long, negative_score long, negative_hash long")
    order = Window.partitionBy("anchor_id", "anchor_hash", "positive_id", "positive_hash").orderBy(F.desc("negative_score"), "negative_id", "negative_hash")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    cells = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    whole = rows.where(finite).select("vec_id", label.alias("label"), cells.alias("vector"))
    return hard_negatives(whole, F.col("vec_id") % 100 == 0)
