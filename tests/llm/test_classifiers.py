import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import licenses as L
from corpusloom.llm import quality as Q
from corpusloom.llm import toxicity as T

from . import plain


def joined(spark, sf, df):
    return df.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.1"


def test_quality_on_labels(spark, larger):
    p = joined(spark, larger, Q.op8_quality(spark, larger))
    good, bad = p[p.quality == 1], p[p.quality == 0]
    assert good.kept.mean() > 0.99 and (~bad.kept).mean() > 0.95
    assert ((p.weak_label > 0.5) == (p.quality == 1)).mean() > 0.98


def test_label_model_finds_rates_and_share():
    rng = np.random.default_rng(1)
    n = len(Q.BAD) + len(Q.GOOD)
    rates = rng.uniform(0.05, 0.3, n), rng.uniform(0.4, 0.9, n)
    good = rng.random(40_000) < 0.8
    p_vote = np.where(np.arange(n) < len(Q.BAD), np.where(good[:, None], 0.01, rates[0]), np.where(good[:, None], 0.9, rates[1]))
    votes = rng.random(p_vote.shape) < p_vote
    keys, c = np.unique((votes << np.arange(n)).sum(1), return_counts=True)
    share, rate, post = Q.label_model(dict(zip(keys.tolist(), c.tolist(), strict=True)))
    assert abs(share - 0.8) < 0.05
    assert np.abs(rate[:, 0] - p_vote[good].mean(0)).max() < 0.05
    assert all(0 <= v <= 1 for v in post.values())


def em_by_document(votes, rounds=300):
    """Expectation and maximisation over the votes of each document, one by one."""
    n_bad = len(Q.BAD)
    post = [0.1 if any(v[:n_bad]) else 0.95 for v in votes]
    for _ in range(rounds):
        good, total = sum(post), len(post)
        share = min(0.99, max(0.01, (good + 0.5) / (total + 1)))
        clip = lambda x: min(1 - 1e-5, max(1e-5, x))
        rates = [[clip((sum(p * v[j] for p, v in zip(w, votes, strict=True)) + 0.5) / (sum(w) + 1)) for j in range(len(votes[0]))] for w in (post, [1 - p for p in post])]
        new = []
        for v in votes:
            a, b = (np.prod([r if x else 1 - r for r, x in zip(rs, v, strict=True)]) for rs in rates)
            new.append(share * a / (share * a + (1 - share) * b))
        if max(abs(x - y) for x, y in zip(new, post, strict=True)) < 1e-9:
            break
        post = new
    return new


def test_quality_query_equals_plain(spark, sf_dir):
    """Posteriors by plain EM over each document's votes, and scores by a plain dot product; however rows are dealt."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    rows = {r.doc_id: r for r in Q.op8_quality(spark, sf_dir).collect()}
    m = {i: Q.measure(None if t is None else t.encode()) for i, t in docs.items()}
    votes = {i: [abs(v) for v in Q.votes(*m[i])] for i in docs}
    post = dict(zip(votes, em_by_document(list(votes.values())), strict=True))
    assert all(rows[i].weak_label == pytest.approx(post[i], abs=1e-6) for i in docs)
    x = {i: Q.features(None if t is None else t.encode(), *m[i], Q.Shapes()) for i, t in docs.items()}
    key = {r.doc_id: r.key for r in table.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key")).collect()}
    order = sorted(docs, key=key.get)
    cut = lambda v: (v[0], v[1].astype("<f4").astype(float))
    w = Q.train([cut(x[i]) for i in order], np.array([post[i] for i in order]))
    for i in docs:
        z = sum(w[s] * v for s, v in zip(*x[i], strict=True)) + w[Q.DIM]
        assert rows[i].score == pytest.approx(1 / (1 + np.exp(-z)) if m[i][0] else 0.0, abs=1e-4)
    again = {r.doc_id: r.score for r in Q.quality(table.repartition(7, "text")).collect()}
    assert again == {i: r.score for i, r in rows.items()}


def test_quality_edges(docs_of):
    texts = ["A plain sentence, of some words, that nobody minds.", "", None, " \n ", "De.", "SHOUT!! " * 40, "word$$$ other### " * 40, "same " * 300, "a | b | c | d | " * 30]
    texts += ["Another plain sentence of number words goes here without any trouble at all."] * 20
    docs = docs_of(texts).union(docs_of([(0, texts[0]), (None, texts[0])])).withColumn("score", F.lit(1)).withColumn("kept", F.lit("x"))
    rows = Q.quality(docs).collect()
    assert len(rows) == len(texts) + 2
    kept = {r.doc_id: r.kept for r in rows if r.doc_id not in (0, None)}
    assert [i for i in range(1, 9) if kept[i]] == [4]
    assert all(r.kept for r in rows if r.doc_id in (0, None))
    assert {r.score for r in rows if r.doc_id in (1, 2, 3)} == {0.0}
    stayed = Q.quality(docs, filtering=True)
    assert stayed.columns == docs.columns and stayed.count() == sum(r.kept for r in rows)
    assert Q.quality(docs_of(["a"]).where("false")).count() == 0


def test_toxicity_on_held_out_labels(spark, larger):
    p = joined(spark, larger, T.op10_toxicity(spark, larger))
    assert (p.held_out == p.doc_id.map(plain.held_out)).all()
    h = p[p.held_out]
    hit, clean = h[h.toxic == 1], h[h.toxic == 0]
    assert hit.predicted.mean() > 0.75 and clean.predicted.mean() < 0.01
    assert h.score.between(0, 1).all() and ((h.score >= 0.7) == (h.predicted == 1)).all()


def test_labels_of_held_out_rows_are_not_used(spark, docs_of):
    docs = docs_of(["some text"] * 300)
    labels = spark.createDataFrame([(i, 1) for i in range(300) if plain.held_out(i)], "doc_id long, toxic int")
    assert T.labelled(docs, labels, 1000).count() == 0
    both = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(0, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    assert T.labelled(docs, both, 1000).count() == sum(not plain.held_out(i) for i in range(300))
    assert T.labelled(docs, both, 10).count() == 10


def found(text, weights=None, exceptions=T.EXCEPTIONS):
    return [h[2] for h in T.hits(text, T.automaton(weights or {T._same(t): 4.0 for t in T.TERMS}, exceptions))]


def test_folding_and_boundaries():
    assert T.fold("Ａ1d!0T éß") == "aidiot es" and len(T.fold("İﬁ½x")) == 4
    assert found("id\u00edot") == found("idi\u0301ot") == found("id\u200biot") == found("i\u00addiot") == ["idiot"]
    assert [h[:2] for h in T.hits("an i\u0301d\u200biot!", T.automaton({"idiot": 1.0}))] == [(3, 10)]
    assert found("clown  fish, clown\n fish; Clown-fish") == [] and found("what a clown. Fish is good") == ["ciown"]
    assert found("idiot's guide, idiot\u2019s guide") == [] and found("guinea pigs and pigsty and a pig") == ["pig"]
    assert found("you 1D10T!") == ["idiot"] and found("м0r0n, іdіоt") == ["moron", "idiot"]
    assert found("idiotic scumbag") == [] and found("a clown fish and a clown") == ["ciown"]
    assert found("trash can") == [] and found("trash cans are trash") == ["trash"]
    assert found("idiot### \"moron\"") == ["idiot", "moron"]
    assert found("badly bad badge", {"bad*": 1.0}) == ["bad*"] * 3


def plain_hits(text, terms, exceptions=T.EXCEPTIONS):
    """Fold and search, a position and a phrase at a time."""
    import re
    import unicodedata

    at = [i for i, c in enumerate(text) if not unicodedata.combining(c) and c not in "\u200b\u00ad"]
    kept = [text[i] for i in at]
    low = [T.FOLD.get(ord(c), c) for c in kept]
    alone = lambda s, e: not (s and kept[s - 1].isalnum()) and not (e < len(kept) and kept[e].isalnum())
    found = []
    for s in range(len(low)):
        for t in terms:
            e = s + len(t)
            if "".join(low[s:e]) == t and alone(s, e):
                inside = False
                for p in exceptions:
                    for m in re.finditer("(?=(" + " +".join(map(re.escape, T._same(p).split())) + "))", "".join(low)):
                        inside |= alone(*m.span(1)) and m.start(1) <= s and e <= m.end(1)
                if not inside:
                    found.append((at[s], at[e - 1] + 1, t))
    return sorted(found)


def test_hits_equal_plain_search():
    rng = np.random.default_rng(7)
    parts = ["clown", "fish", "trash", "can", "cans", "idi", "ot", "ídiot", "i\u0301diot", "id\u200biot", "1d!ot", "pig", "guinea", "not", "stupid", " ", "  ", "\n", ".", "-", "x", "\u00ad"]
    lexicon, terms = T.automaton({T._same(t): 1.0 for t in T.TERMS}), {T._same(t) for t in T.TERMS}
    for _ in range(400):
        text = "".join(rng.choice(parts, rng.integers(1, 14)))
        assert sorted(h[:3] for h in T.hits(text, lexicon)) == plain_hits(text, terms), text


def test_toxicity_query_equals_plain(spark, sf_dir):
    """Scores from the fitted lexicon and weights by the plain search; one weight vector explains all scores."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = T.op10_toxicity(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    sample = T.labelled(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")), 6000)
    weights, least = {T._same(w): 4.0 for w in T.TERMS}, {}
    for w, (r, times) in T.learn_terms(sample).items():
        weights.pop(w.rstrip("*"), None)
        weights[w], least[w] = min(6.0, r), times
    lexicon = T.automaton(weights)
    x = {i: T.measures(t, lexicon, least) for i, t in docs.items()}
    some = sample.collect()
    w = T.fit(np.array([T.measures(r.text, lexicon, least) for r in some]), np.array([float(r.toxic > 0) for r in some]))
    for r in rows:
        z = w[0] + np.dot(w[1:], x[r.doc_id])
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9) and r.predicted == int(r.score >= 0.7)


def test_repeated_ids_are_one_labelled_text(spark, docs_of):
    docs = docs_of([(3, "b"), (3, "a"), (3, "a"), (4, "c")])
    labels = spark.createDataFrame([(3, 0), (4, 1), (5, 1)], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in T.labelled(docs, labels, 10).collect()) == [(i, t, y) for i, t, y in ((3, "a", 0), (4, "c", 1)) if not plain.held_out(i)]


def test_very_long_texts(docs_of, spark):
    long = "a fine day, and nothing else. " * 40_000
    docs = docs_of([(1, long), (2, long + "you idiot " * 2000), (3, "short and plain text here")])
    assert T.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 3
    assert Q.quality(docs).count() == 3


def test_toxicity_edges(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = docs_of(["you idiot", "", None, "nice day", (None, "moron"), ("x" * 1) and (1, "again")]).withColumn("score", F.lit("s")).withColumn("toxic", F.lit(0))
    rows = T.toxicity(docs, labels).collect()
    assert len(rows) == 6
    by = {(r.doc_id, round(r.score, 3)): r.predicted for r in rows}
    assert [p for (i, _), p in by.items() if i == 0] == [1] and [p for (i, _), p in by.items() if i in (2, 3)] == [0, 0]
    assert T.toxicity(docs_of(["a"]).where("false"), labels).count() == 0


LINES = [
    ("Released under the MIT License.", "MIT"),
    ("some words. Licensed under the Apache License, Version 2.0.", "Apache"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "BSD"),
    ("He got a fishing license at the town hall.", L.UNKNOWN),
    ("With the permission of the owner we crossed the field.", L.UNKNOWN),
    ("SPDX-License-Identifier: MIT", "MIT"),
    ("SPDX-License-Identifier: Apache-2.0", "Apache"),
    ("SPDX-License-Identifier: Zlib", L.UNKNOWN),
    ("SPDX-License-Identifier: Python-2.0", L.UNKNOWN),
]


def test_license_families():
    for text, family in LINES:
        got, p, t, overlap = L.classify(text)
        assert got == family, (text, got, p)
        assert family == L.UNKNOWN or overlap >= L.CONFIRM


def test_calibration_texts_are_new_and_mostly_right():
    """Other wordings and other families; nothing of another family is confirmed."""
    trained_on = {t for _, t in L.TEMPLATES} | set(L.OTHER)
    got = [(f, *L.classify(t)) for f, t in L.CALIBRATION if t not in trained_on]
    assert len(got) == len(L.CALIBRATION)
    assert sum(f == g for f, g, *_ in got) >= 0.85 * len(got)
    assert not [x for x in got if x[0] == L.UNKNOWN and x[1] != L.UNKNOWN and x[4] >= L.CONFIRM]


def test_licenses_equal_plain_python(spark, docs_of, sf_dir):
    import re

    docs = docs_of([t for t, _ in LINES] + ["\n".join(t for t, _ in LINES), "", None, "no anchor", "LICENSE", "license " * 3000])
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select(docs.columns)
    for df in (docs.withColumn("row", F.lit(1)).withColumn("g", F.lit(2)), real):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for r in L.paragraphs(df).collect():
            want = [(i, *L.classify(x)) for i, x in enumerate(texts[r.doc_id].split("\n")) if re.search(L.ANCHOR, x)]
            assert [(c.line, c.family, c.template) for c in r.candidates] == [(i, f, t) for i, f, _, t, _ in want]
            assert [c.probability for c in r.candidates] == pytest.approx([p for _, _, p, _, _ in want], abs=1e-6)
            assert [c.overlap for c in r.candidates] == pytest.approx([o for *_, o in want], abs=1e-6)


def test_licenses_edges(spark, docs_of, sf_dir):
    assert L.paragraphs(docs_of(["a"]).where("false")).count() == 0
    twice = L.paragraphs(docs_of([(1, LINES[0][0]), (1, LINES[0][0]), (None, LINES[0][0])])).collect()
    assert [len(r.candidates) for r in twice] == [1, 1, 1]
    plan = L.op3_licenses(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
