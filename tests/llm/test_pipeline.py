"""The pipeline against plain Python versions of its stages."""

import base64
import random

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import quality as Q
from corpusloom.llm.tokens import Encoder, vocabulary

from . import plain
from .test_tokens import check_rows


def test_stages_against_plain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r.doc_id for r in Q.quality(docs).where("kept").collect()}
    texts = {i: t for i, t in texts.items() if i in kept}
    texts = {i: texts[i] for i, _, c in plain.near_duplicates(list(texts.items())) if i == c}
    texts = {r[0]: texts[r[0]] for r in plain.contaminated(list(texts.items()), items) if not r[2]}
    marked = {}
    for i, t in texts.items():
        spans = sorted((a, b) for a, _, b in plain.base_secrets(t))
        out, at = [], 0
        for a, b in spans:
            if a > at or (a == 0 and not out):
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        marked[i] = "".join(out) + t[at:]
    check_rows(P.run(spark, sf_dir).collect(), marked, Encoder(vocabulary()))


def test_columns_and_effects(spark, docs_of, sf_dir):
    prose = "It was a plain day, and nothing much had happened in the town by noon. "
    rows = [(3, prose), (2, prose), (None, prose), (4, ""), (5, None), (6, "SHOUT!! " * 60), (7, prose + 'password="abcdefgh12" and on it went, quietly, for hours.')]
    token = base64.b64encode(random.Random(4).randbytes(48)).decode()
    rows += [(8, f"{prose}Later they found that the key was {token} and kept quiet about it, which was for the best.")]
    rows += [(100 + i, f"{prose} Number {i} says so, and who are we to doubt it on day {i * 7}?") for i in range(30)]
    docs = docs_of(rows).withColumn("extra", F.col("text"))
    one = P.quality_stage(spark, docs, sf_dir)
    assert one.columns == list(P.COLUMNS)
    assert {r.doc_id for r in one.collect()} >= {2, 3, 7, None} and not {r.doc_id for r in one.collect()} & {4, 5, 6}
    two = P.near_dedup_stage(spark, one, sf_dir)
    assert {r.doc_id for r in two.collect()} & {2, 3, None} == {2}
    three = P.decontamination_stage(spark, two, sf_dir)
    assert three.count() == two.count()
    four = {r.doc_id: r for r in P.secrets_stage(spark, three, sf_dir).collect()}
    assert "[SECRET]" in four[7].text and "abcdefgh12" not in four[7].text and four[7].n_chars == len(four[7].text)
    assert token not in four[8].text and four[8].text.count("[SECRET]") == 1
    assert four[2].text == prose
    assert np.all([r.n_chars >= 0 for r in four.values()])
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text.split()
    long = "word and other words " * 1250
    cases = docs_of([(1, long), (2, long + " ".join(passage[1:14]) + " " + long), (3, " ".join(passage[:12])), (4, None), (None, " ".join(passage))])
    assert sorted(r.doc_id for r in P.decontamination_stage(spark, cases, sf_dir).collect()) == [1, 3, 4]
    copies = docs_of([(None, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (None, "A b c d e f"), (9, "l m n o p"), (9, "L m n o p"), (9, "L m n o p"), (5, None), (6, "")])
    left = [(r.doc_id, r.text) for r in P.near_dedup_stage(spark, copies, sf_dir).collect()]
    assert sorted(len({t for i, t in left if i == k}) for k in (9, 5)) == [1, 1] and (6, "") not in left
    assert {t.lower() for i, t in left if i is None} == {"a b c d e f", "q r s t u v"} and len({t for i, t in left if i is None}) == 2
    empty = docs_of(["a"]).where("false")
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
