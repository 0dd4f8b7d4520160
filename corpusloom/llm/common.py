"""What the training-data operators share: tables, the shared folder, cutting lineage, connected components."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, discarded, scratch, ship, written

__all__ = ["Forest", "binary", "components", "cut", "cut_by", "discarded", "release", "scratch", "spread_join", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_by(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` dealt by keys and kept like that: later groups and cogroups by the keys come to it without another shuffle.

    Spark remembers how rows were dealt only if the plan is not an adaptive one.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    had = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df.repartition(n, *keys))
    finally:
        conf.set(name, had)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column's UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


#: Narrow rows that one task joins without care, whatever their keys.
ONE_TASK = 1 << 21


def spread_join(rows: DataFrame, names: DataFrame, key: str, total: int, count: str = "count", most: int = 256, one_task: int = ONE_TASK, how: str = "left") -> DataFrame:
    """rows joined by a key (left, or inner where every key is known) with names, which has a key once, and how many rows have it (as ``count``).

    Up to one_task rows it is a plain join. Of more, keys with more than a ``most``-th of ``total`` rows, of which there are fewer than ``most``, are broadcast; the others are shuffled, so no
    task gets the rows of a frequent key. Rows without a key stay where they are.
    """
    if total <= one_task:
        return rows.join(names.drop(count), key, how).select(*rows.columns, *[c for c in names.columns if c not in (key, count)])
    hot = names.where(F.col(count) * most > F.lit(total)).drop(count)
    few = hot.select(F.col(key).alias("k"), F.struct(*[F.col(c) for c in hot.columns if c != key]).alias("v"))
    marked = rows.join(F.broadcast(few), rows[key].eqNullSafe(few["k"]), "left").drop("k")
    more = [c for c in hot.columns if c != key]
    here = marked.where(F.col("v").isNotNull() | (F.col(key).isNull() & F.lit(how == "left"))).select(*rows.columns, *[F.col("v")[c].alias(c) for c in more])
    there = marked.where(F.col("v").isNull() & F.col(key).isNotNull()).select(*rows.columns).join(names.where(F.col(count) * most <= F.lit(total)).drop(count), key, how)
    return here.select(*rows.columns, *more).unionByName(there.select(*rows.columns, *more))


class Forest:
    """Union-find over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return up
            self.up = up


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each batch as stars around the smallest node: as many rows at most, and the same components."""
    for b in batches:
        a, z = b.column("a").to_numpy(), b.column("b").to_numpy()
        if not len(a):
            continue
        nodes, inverse = np.unique(np.concatenate([a, z]), return_inverse=True)
        f = Forest(len(nodes))
        f.join(inverse[: len(a)], inverse[len(a) :])
        root = f.roots()
        keep = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root[keep]])], names=["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges`` (a long, b long) as (node, root): root is the smallest node reachable; nodes that are their own root are left out.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each a minimum per node and a join in which
    nodes with very many edges are broadcast, so that neither a hub nor a component ever meets in one task; every round is cut
    by a checkpoint. No edges give no rows.
    """

    def narrowed(e: DataFrame) -> DataFrame:
        e = e.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
        return e.mapInArrow(_stars, "a long, b long").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    ship(edges.sparkSession)
    e = cut(narrowed(edges))
    seen = state(e)
    for _ in range(max_rounds):
        edges = 2 * int(seen[0])
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("count")).select("a", F.least("a", "m").alias("m"), "count")
        large = spread_join(both.where("b > a"), least, "a", edges, how="inner").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("count"))
        small = spread_join(large, low, "a", edges, how="inner").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = state(e)
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
