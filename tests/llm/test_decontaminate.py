from types import SimpleNamespace

from corpusloom.llm import decontaminate as D

from . import plain

LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "Is it so?"), (3, None), (4, "..."), (None, "unnamed item text"), (10, "W3 w4 W5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (1, "again twice"), (5, "ÉTÉ été naïve")]
DOCS = [
    "x " + " ".join(f"w{i}" for i in range(5, 19)) + " y",
    " ".join(f"w{i}" for i in range(5, 17)),
    "is it so is it so, IS-IT,SO",
    "an unnamed   item\ntext",
    None,
    "",
    "... ---",
    LONG + " " + LONG,
    "word " * 3000 + "again twice",
    "Été ÉTÉ été naïve",
    "é ß ÉTÉ été naïve, ñ",
]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def digest(found):
    from pyspark.sql import functions as F

    return sorted(
        tuple(r)
        for r in found.select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.array_join(F.array_sort("items"), ","), 256), D.is_contaminated(F.col("n_hit"), F.col("n_words"))
        ).collect()
    )


def test_against_plain(spark, docs_of):
    items = [x for x in ITEMS if x[0] is not None]
    assert digest(D.contamination(docs_of(DOCS), bench(spark, items))) == plain.contaminated(list(enumerate(DOCS)), items)


def test_small_blocks_give_the_same(spark, docs_of):
    docs = docs_of(DOCS + [DOCS[0], DOCS[7]])
    found = [D.contamination(docs, bench(spark), max_block_bytes=n) for n in (10**6, 100)]
    assert digest(found[0]) == digest(found[1])
    one, many = (sorted((r.doc_id, r.items, [tuple(s) for s in r.spans]) for r in f.collect()) for f in found)
    assert one == many
    kept = [sorted(r.doc_id for r in D.clean_documents(docs, bench(spark), max_block_bytes=n).collect()) for n in (10**6, 100)]
    assert kept == [[1, 4, 5, 6]] * 2


def test_random_texts_against_plain(spark, docs_of, monkeypatch):
    """Few words, so that anchors recur and overlap; with hot anchors too."""
    import random

    rng = random.Random(3)
    text = lambda n: " ".join(rng.choices("abc", k=n))
    items = [(i, text(rng.randint(0, 40))) for i in range(60)]
    docs = [text(rng.randint(0, 300)) for _ in range(40)] + [items[5][1], items[7][1] + " x " + items[8][1]]
    want = plain.contaminated(list(enumerate(docs)), items)
    for hot in (1, 32):
        block = D.Block(13)
        for i, t in items:
            if D.words_of(t.encode()):
                block.add(str(i), D.words_of(t.encode()))
        monkeypatch.setattr(D, "HOT", hot)
        m = D.Matcher(block)
        for (i, n, hit, n_items, _, _), t in zip(want, docs, strict=True):
            size, found, runs = D.scan(t.encode(), m)
            assert (size, sum(r["v"] - r["w"] for r in runs), len(found)) == (n, hit, n_items), i
    for n in (1, 2, 3, 6):
        block = D.Block(n)
        block.add("1", D.words_of(items[1][1].encode()))
        m = D.Matcher(block)
        for (i, size, hit, *_), t in zip(plain.contaminated(list(enumerate(docs)), [items[1]], n), docs, strict=True):
            assert sum(r["v"] - r["w"] for r in D.scan(t.encode(), m)[2]) == hit, (n, i)


def test_five_thousand_items_are_one_automaton():
    """Windows of them would be 13 times their 1.4 MB; here every word of the texts is one of theirs, the worst case. Nothing is built anew for a text: what a larger automaton costs is memory further away."""
    import random
    import time

    rng = random.Random(1)
    vocabulary = [f"{rng.getrandbits(24):x}" for _ in range(20_000)]
    words = [[w.encode() for w in rng.choices(vocabulary, k=40)] for _ in range(5000)]
    texts = [" ".join(rng.choices(vocabulary, k=3000)).encode() for _ in range(30)]
    texts[3] += b" " + b" ".join(words[4000][5:18])
    took = []
    for n in (50, 5000):
        block = D.Block(13)
        for i, w in enumerate(words[:n]):
            block.add(str(i), w)
        m = D.Matcher(block)
        best = float("inf")
        for _ in range(3):
            began = time.perf_counter()
            found = [D.scan(t, m) for t in texts]
            best = min(best, time.perf_counter() - began)
        took.append(best)
    assert [f[1] for f in found if f[1]] == [["4000"]]
    assert took[1] < 10 * took[0] + 0.02
    shared = SimpleNamespace(value=(block.key(), block))
    assert D._matcher(shared) is D._matcher(SimpleNamespace(value=(block.key(), block)))


def test_item_without_id(spark, docs_of):
    row = {r.doc_id: r for r in D.contamination(docs_of(DOCS), bench(spark)).collect()}[3]
    assert (row.n_words, row.n_hit, row.items) == (4, 3, [])


def test_spans_are_offsets_in_the_original(spark, docs_of):
    for r in D.contamination(docs_of(DOCS), bench(spark)).collect():
        if r.doc_id == 2:
            assert [(s.start, s.end) for s in r.spans] == [(0, len(DOCS[2]))]
        if r.doc_id in (9, 10):
            assert [DOCS[r.doc_id][s.start : s.end] for s in r.spans] == ["ÉTÉ été naïve"]


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(tuple(r) for r in D.op2_decontaminate(spark, sf_dir).collect())
    assert got == plain.contaminated(docs, items)


def test_edges(spark, docs_of):
    assert D.contamination(docs_of(["a"]), bench(spark, [])).first().n_hit == 0
    assert D.contamination(docs_of(["a"]).where("false"), bench(spark)).count() == 0
    twice = docs_of([(1, "is it so"), (1, "is it so"), (None, "is it so")]).withColumnRenamed("lang", "items").withColumnRenamed("source", "n_hit")
    assert sorted((r.doc_id is None, r.n_hit) for r in D.contamination(twice, bench(spark)).collect()) == [(False, 3), (False, 3), (True, 3)]
    docs = docs_of([*DOCS, "word " * 5000 + LONG, (None, "is it so"), (None, "fine"), (1, DOCS[1])]).withColumnRenamed("source", "items").withColumnRenamed("lang", "runs")
    kept = D.clean_documents(docs, bench(spark))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.where("doc_id IS NOT NULL").collect()) == [(False, i) for i in (1, 1, 4, 5, 6)]
    assert [r.text for r in kept.where("doc_id IS NULL").collect()] == ["fine"]
    assert D.clean_documents(docs, bench(spark, [])).count() == docs.count()
    assert D.clean_documents(docs.where("false"), bench(spark)).count() == 0
