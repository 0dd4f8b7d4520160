import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.llm import simhash as H

from . import plain


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect())


def near_texts(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(8):
        base = rng.choices(vocab, k=400)
        for k in range(6):
            t = list(base)
            for _ in range(k):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            out.append(" ".join(t))
    return [*out, "", None, "\t\n ", "one", "ONE", "one two three", "É é", " x  y\tz w v", out[0]]


def test_against_plain(docs_of):
    texts = near_texts()
    assert got(H.near_duplicates(docs_of(texts))) == plain.near_duplicates(list(enumerate(texts)))


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = sorted(tuple(r) for r in H.op7_simhash(spark, sf_dir).collect())
    assert rows == plain.near_duplicates(docs)


@pytest.mark.parametrize("distance,groups,block", [(4, 6, 4096), (4, 7, 4), (2, 4, 8)])
def test_links_lose_nothing(spark, distance, groups, block):
    """Dense groups of fingerprints, with small chunks: the forest connects what brute force connects."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set()
    for b in base:
        for _ in range(40):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(bit)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    reps = spark.createDataFrame([(x, i) for i, x in enumerate(fps)], "fp long, rep long")
    roots = {r.node: r.root for r in common.components(H.links(reps, distance, groups, block)).collect()}
    f = common.Forest(len(fps))
    u = np.array(fps, np.int64).view(np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= distance, 1))
    f.join(a, b)
    assert [roots.get(i, i) for i in range(len(fps))] == f.roots().tolist()


def test_embedding_is_a_lower_bound(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 63), 1 << 63, 300, dtype=np.int64)
    e = np.array([r[0] for r in spark.createDataFrame([(int(v),) for v in x], "fp long").select(H.embedding(F.col("fp"))).collect()])
    u, v = x.view(np.uint64), e.view(np.uint64)
    counts = np.stack([np.bitwise_count((u >> np.uint64(2 * s)) & np.uint64(3)) for s in range(32)], 1).astype(int)
    manhattan = np.abs(counts[:, None] - counts[None]).sum(2)
    assert (np.bitwise_count(v[:, None] ^ v[None]) == manhattan).all()
    assert (manhattan <= np.bitwise_count(u[:, None] ^ u[None])).all()


def test_edges(docs_of):
    assert H.near_duplicates(docs_of(["a"]).where("false")).count() == 0
    rows = got(H.near_duplicates(docs_of([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "q r s t u")]).withColumn("fp", F.lit(1)).withColumn("rep", F.lit(1))).where("doc_id IS NOT NULL"))
    assert [(r[0], r[2]) for r in rows] == [(5, 5), (5, 5)]


def test_rows_without_id_link(docs_of):
    """Two documents that only a row without an id connects, a group without ids, and a keeper for each."""
    words = [f"w{i}" for i in range(300)]
    fp = H.fingerprint(" ".join(words).encode())
    near = []
    for k in range(300):
        t = " ".join([*words[:k], "x", *words[k + 1 :]])
        d = (H.fingerprint(t.encode()) ^ fp).bit_count()
        if 0 < d <= 4:
            near.append(t)
    a, b = next((a, b) for a in near for b in near if (H.fingerprint(a.encode()) ^ H.fingerprint(b.encode())).bit_count() > 4)
    rows = H.near_duplicates(docs_of([(7, a), (None, " ".join(words)), (3, b), (None, "q r s t u"), (None, "q r s t u")])).collect()
    assert sorted(r.component_id for r in rows if r.component_id is not None) == [3, 3, 3]
    alone = [r for r in rows if r.component_id is None]
    assert len(alone) == 2 and {r.keeper for r in alone} == {alone[0].text_hash}


def test_groups_by_size(docs_of):
    sizes = [H.groups_for(10**k, 4) for k in range(3, 12)]
    assert sizes == sorted(sizes) and sizes[0] == 6 and sizes[-1] >= 9
    texts = near_texts()
    want = got(H.near_duplicates(docs_of(texts)))
    assert got(H.near_duplicates(docs_of(texts), groups=9)) == want


def test_spread_join(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 3 + [3, 9] + [None] * 20)], "key int, i int")
    names = spark.createDataFrame([(1, "a", 50), (2, "b", 3), (3, "c", 1)], "key int, name string, count long")
    want = {1: "a", 2: "b", 3: "c"}
    for few in (0, 1000):
        found = common.spread_join(rows, names, "key", 75, most=4, one_task=few)
        assert found.columns == ["key", "i", "name"]
        inner = common.spread_join(rows, names, "key", 75, most=4, one_task=few, how="inner")
        assert sorted((r.i, r.name) for r in inner.collect()) == [(r.i, want[r.key]) for r in rows.orderBy("i").collect() if r.key in want]
        assert sorted((r.i, r.name) for r in found.collect()) == [(r.i, want.get(r.key)) for r in rows.orderBy("i").collect()]


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(common.spread_join, "__defaults__", ("count", 4, 0, "left"))
    edges = [(0, i) for i in range(1, 200)] + [(i, 1000 + i) for i in range(1, 200)] + [(5000, 5001)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 200)}, **{1000 + i: 0 for i in range(1, 200)}, 5001: 5000}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 300)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 160)}, 300: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
