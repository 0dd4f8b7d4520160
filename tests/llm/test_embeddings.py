import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import embeddings as E


def brute(vectors, least=0.95):
    """(n_links, component) by row number of (id, vector)."""
    ok = [i for i, (_, v) in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(vectors))}
    for a in ok:
        for b in ok:
            x, y = np.array(vectors[a][1], float), np.array(vectors[b][1], float)
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[a].add(b)
    name = {i: vectors[i][0] for i in links}
    for _ in links:
        name = {i: min([name[i], *(name[j] for j in links[i])]) for i in links}
    return [(vectors[i][0], len(links[i]), name[i]) for i in links]


def frame(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<float>")


def rows(df):
    return sorted((r.vec_id, r.n_links, r.component_id) for r in df.collect())


def clustered(n_groups=20, size=25, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(n_groups):
        centre = rng.normal(size=dim)
        for k in range(size):
            v = centre + rng.normal(size=dim) * 0.12 * (k % 5)
            out.append([float(x) for x in v.astype(np.float32)])
    return [(7 * i + 3, v) for i, v in enumerate(out)]


def test_against_brute_force(spark):
    vectors = clustered()
    assert rows(E.linked(frame(spark, vectors))) == sorted(brute(vectors))


@pytest.mark.parametrize("shard_rows", [150, 60])
def test_many_shards_find_the_same(spark, monkeypatch, shard_rows):
    """Clusters lie across shards: the search goes on from shard to shard. Comparison of all pairs is out of reach."""
    monkeypatch.setattr(E, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(E, "TASK_ROWS", 40)
    monkeypatch.setattr(E, "_compare_all", None)
    vectors = clustered()
    placed = E.deal(E._sizes(frame(spark, vectors).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))), 3)
    sizes = placed.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("h")).toPandas()
    assert len(sizes) > 5 and sizes.n.max() <= shard_rows and sizes.h.sum() == len({tuple(v) for _, v in vectors})
    got, want = rows(E.linked(frame(spark, vectors))), sorted(brute(vectors))
    assert [(i, c) for i, _, c in got] == [(i, c) for i, _, c in want]
    assert sum(n for _, n, _ in got) >= 0.97 * sum(n for _, n, _ in want) and all(a[1] <= b[1] for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("size", [300, 900])
def test_one_dense_cluster_over_many_shards(spark, monkeypatch, size):
    """A third of the vectors, all different and all near each other, in many more shards than a vector has."""
    monkeypatch.setattr(E, "SHARD_ROWS", 64)
    rng = np.random.default_rng(2)
    hot = rng.normal(size=16) + 0.08 * rng.normal(size=(size // 3, 16))
    vectors = [(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate([*hot, *rng.normal(size=(size - size // 3, 16))])]
    got, want = rows(E.linked(frame(spark, vectors))), sorted(brute(vectors))
    assert sum(n for _, n, _ in got) >= 0.9 * sum(n for _, n, _ in want)
    assert [(i, c) for i, _, c in got] == [(i, c) for i, _, c in want]


def test_search_meets_what_is_in_range():
    x = E.unit(np.array([v for _, v in clustered()]))
    start, flat = E.linked_by(E.robust_prune(x), len(x))
    found = set()
    for q, v, s in E.search(x, start, flat, x, [np.array([0, i]) for i in range(len(x))], 0.95):
        found |= {(a, b) for a, b, c in zip(q.tolist(), v.tolist(), s.tolist(), strict=True) if c >= 0.95}
    a, b = np.nonzero(x @ x.T >= 0.95)
    true = set(zip(a.tolist(), b.tolist(), strict=True))
    assert found <= true and len(found) >= 0.99 * len(true)


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    vectors = [
        (1, v), (2, v), (2, v), (3, [2.0, 4.0, 6.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [float("nan"), 2.0, 3.0]), (8, [float("inf"), 1.0, 1.0]),
        (9, []), (10, [1.0, 2.0]), (11, [2.0, 4.0]), (12, [-1.0, -2.0, -3.0]), (13, [0.0, 0.0, 0.0]),
    ]
    df = frame(spark, vectors).withColumn("label", F.lit(1)).withColumn("count", F.lit(5)).withColumn("id", F.lit("x"))
    out = E.linked(df)
    assert rows(out) == sorted(brute(vectors))
    assert {r.vec_id for r in out.collect() if not r.kept} == {2, 3, 11}
    assert E.linked(frame(spark, vectors).where("false")).count() == 0


def test_many_copies_cost_no_pairs(spark):
    vectors = [(i, [1.0, 0.5, 0.25]) for i in range(3000)] + [(3000, [1.0, 0.5, 0.26])]
    out = E.linked(frame(spark, vectors)).agg(F.min("n_links"), F.max("n_links"), F.max("component_id")).first()
    assert tuple(out) == (3000, 3000, 0)


def test_recall_is_measured(spark):
    vectors = clustered()
    nodes = E._sizes(frame(spark, vectors).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")))
    true = {i: n for i, n, _ in brute(vectors)}
    full = spark.createDataFrame([(i, n) for i, n in true.items() if n], "id long, n long")
    assert E._recall(nodes, full, len(vectors), 0.95, 50) == pytest.approx(1.0)
    assert E._recall(nodes, full.where("false"), len(vectors), 0.95, 500) == 0.0


def test_query(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert rows(E.op4_embeddings(spark, sf_dir)) == sorted(brute(vectors))
