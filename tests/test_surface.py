from collections import Counter

import pytest

from corpusloom.functions.register import register
from corpusloom.operators.bpe import distributed
from corpusloom.operators.bpe.codec import Codec
from corpusloom.plans.report import fixed_width


def test_sql_functions(spark):
    lines = spark.createDataFrame([("to be or not to be",), ("to be is to do",)], "text string")
    model = distributed.train(lines, 4, 4, more=True)
    register(spark, model)
    row = spark.sql("SELECT preprocess_text('é') AS a, bpe_decode(bpe_encode('to be é')) AS b, preprocess_text(NULL) AS c").first()
    assert row.a.startswith("e[U+00E9") and row.b == "to be é" and row.c is None
    assert [r.token for r in spark.sql("SELECT * FROM bpe_tokens('to be is') ORDER BY place").collect()] == ["to be ", "is"]
    base = distributed.train_words(lines, 4, more=True)
    assert base.stage1 == model.stage1 and base.stage2 == []
    assert distributed.seconds_per_merge(lines, base, 3)["merges"] == 3


def test_token_counts_by_partition(spark):
    rows = [("a", 0, "to be or not to be"), ("a", 1, "to be is to do"), ("b", 0, None), ("b", 0, ""), (None, 0, "to be é")]
    lines = spark.createDataFrame(rows, "lang string, bucket int, text string")
    model = distributed.train(lines.where("text <> ''"), 4, 4, more=True)
    register(spark, model)
    lines.createOrReplaceTempView("some_lines")
    got = {(r.lang, r.bucket, r.token): r.n for r in spark.sql("SELECT * FROM bpe_token_counts(TABLE(some_lines) PARTITION BY (lang, bucket), 'text')").collect()}
    want = Counter((k, b, Codec(model).string(i)) for k, b, t in rows for i in Codec(model).encode(t or ""))
    assert got == want
    with pytest.raises(Exception, match="text column"):
        spark.sql("SELECT * FROM bpe_token_counts(TABLE(some_lines) PARTITION BY (lang), 'words')").collect()


def test_fixed_width(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("bb", 2000, None)], "name string, n long, x double")
    assert fixed_width(df).split("\n") == ["name      n       x", "a         1  0.5000", "bb    2,000"]
