import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import suffixes as S

from . import plain


def regions_and_docs(rng, n=14):
    regions = sorted({bytes(rng.choices(b"ab\0", k=rng.randint(5, 12))) for _ in range(rng.randint(1, n))})
    return regions, np.array([rng.randint(0, 50) for _ in regions])


def symbols(regions):
    lens = np.array([len(r) for r in regions])
    text = np.frombuffer(b"\0".join(regions) + b"\0", np.uint8)
    s = text.astype(np.int16) + 1
    ends = np.cumsum(lens + 1) - 1
    s[ends] = 0
    return s, ends - lens, ends


def test_suffix_array_and_common_prefixes():
    rng = random.Random(0)
    for _ in range(150):
        regions, _ = regions_and_docs(rng)
        s, starts, ends = symbols(regions)
        stop = {int(e): k for k, e in enumerate(ends)}
        full = [tuple((0, stop[i]) if i in stop else (int(s[i]), 0) for i in range(p, len(s))) for p in range(len(s))]
        want = sorted(range(len(s)), key=full.__getitem__)
        sa = S.suffix_array(s)
        assert sa.tolist() == want
        lcp = S.common_prefixes(s, sa, starts, ends, 5)
        for k in range(1, len(want)):
            if want[k] not in stop:
                n = 0
                while n < 5 and full[want[k - 1]][n] == full[want[k]][n]:
                    n += 1
                assert lcp[k] == n


@pytest.mark.parametrize("block", [1 << 20, 30, 1])
def test_first_documents(block):
    rng = random.Random(1)
    for _ in range(60):
        regions, docs = regions_and_docs(rng)
        best: dict[bytes, int] = {}
        for r, d in zip(regions, docs.tolist(), strict=True):
            for i in range(len(r) - 4):
                best[r[i : i + 5]] = min(best.get(r[i : i + 5], 99), d)
        got = S.first_documents(regions, docs, 5, block)
        assert [g.tolist() for g in got] == [[best[r[i : i + 5]] for i in range(len(r) - 4)] for r in regions]


def test_seeds_cover_all_windows_and_depend_on_content_alone():
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"abcd ", k=n)) for n in (0, 49, 50, 51, 300, 2000)]
    by_window: dict[bytes, set[int]] = {}
    for chunk in (1 << 17, 64):
        t, first, n, h = S.seeds(texts, 50, chunk)
        seen = sorted((a, f + i) for a, f, k in zip(t.tolist(), first.tolist(), n.tolist(), strict=True) for i in range(k))
        assert seen == [(a, i) for a, x in enumerate(texts) for i in range(len(x) - 49)]
        for a, f, k, x in zip(t.tolist(), first.tolist(), n.tolist(), h.tolist(), strict=True):
            for i in range(k):
                by_window.setdefault(texts[a][f + i : f + i + 50], set()).add(x)
    assert all(len(v) == 1 for v in by_window.values())


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(2, 8)))
    passages = ["".join(word() for _ in range(n)) for n in (15, 20, 40, 80)]
    out = []
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 5))]
        out.append("".join(parts))
    return [*out, out[3], out[3][10:], "ab" * 400, "ba" * 300, "x" * 49, "x" * 50, "x" * 51, "", None, "é" * 100]


def got(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("how", [{}, {"hot": 2}, {"fan": 3, "block": 400}])
def test_against_plain(docs_of, how):
    texts = corpus()
    assert got(S.repeats(docs_of(texts), **how)) == plain.repeats(list(enumerate(texts)))


@pytest.mark.parametrize("block", [1 << 12, 1 << 15])
def test_blocks_are_merged_where_they_border_within_a_seed(spark, sf_dir, block):
    """Stretches as the query deals them: merging by binary search runs and finds windows, and the result is that of plain counting."""
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids, texts = list(docs), list(docs.values())
    t, first, n, h = S.seeds(texts, 50)
    again = np.isin(h, [x for x, c in zip(*np.unique(h, return_counts=True), strict=True) if c > 1])
    low: dict[tuple[int, bytes], int] = {}
    for a, f, k, x in zip(t[again].tolist(), first[again].tolist(), n[again].tolist(), h[again].tolist(), strict=True):
        key = (x & 0xFFFFFFFF, texts[a][f : f + k + 49])
        low[key] = min(low.get(key, ids[a]), ids[a])
    order = sorted(low)
    met: list[int] = []
    found = S.first_documents([x for _, x in order], np.array([low[k] for k in order]), 50, block, np.array([x for x, _ in order]), met)
    assert met and sum(met) > 0
    best: dict[bytes, int] = {}
    for k in order:
        for i in range(len(k[1]) - 49):
            w = k[1][i : i + 50]
            best[w] = min(best.get(w, low[k]), low[k])
    assert all(f.tolist() == [best[k[1][i : i + 50]] for i in range(len(k[1]) - 49)] for k, f in zip(order, found, strict=True))


def test_blocks_of_one_seed_are_merged_in_so_many_merges():
    """Bytes of all values; a seed's blocks are merged two by two, not each with each other."""
    rng = random.Random(8)
    ends = [bytes(rng.choices([0, 1, 97, 254, 255], k=30)) for _ in range(40)]
    regions = sorted({rng.choice(ends) + b"the seed of them all" + rng.choice(ends) for _ in range(400)})
    docs = np.array([rng.randrange(100) for _ in regions])
    best: dict[bytes, int] = {}
    for r, d in zip(regions, docs.tolist(), strict=True):
        for i in range(len(r) - 49):
            best[r[i : i + 50]] = min(best.get(r[i : i + 50], 99), d)
    met: list[int] = []
    found = S.first_documents(regions, docs, 50, 1000, np.zeros(len(regions), np.int64), met)
    blocks = -(-len(regions) // (1000 // 81))
    assert len(met) == blocks - 1 and sum(met) > 0
    assert [f.tolist() for f in found] == [[best[r[i : i + 50]] for i in range(len(r) - 49)] for r in regions]


def test_very_long_text(docs_of):
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefgh ", k=600_000))
    found = {r.doc_id: r.n_removed for r in S.repeats(docs_of([(1, long), (2, long[1000:400_000] + "z" + long[:500]), (3, "z")])).collect()}
    assert found == {1: 0, 2: 399_000 + 500, 3: 0}


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in S.op5_repeats(spark, sf_dir).collect()) == plain.repeats(docs)


def test_edges(docs_of):
    long = "the same fifty bytes or more of text, again and again, in all of them"
    rows = [(5, long), (5, long), (None, long), (2, "x"), (9, long), (None, long)]
    docs = docs_of(rows).withColumn("part", F.lit(1)).withColumn("range", F.lit(1)).withColumn("z", F.lit("z"))
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in S.repeats(docs).collect())
    assert found == [(False, 2, 0), (False, 5, 0), (False, 5, 0), (False, 9, len(long)), (True, 0, 0), (True, 0, 0)]
    assert S.repeats(docs_of(["a"]).where("false")).count() == 0
