"""Lines without a language are a language of their own: never dropped, and never taken for the row over all."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.operators import evaluate, mixing
from corpusloom.operators.bpe.distributed import train

from .compare import TABLES, connect, rows

LINE = "lang string, doc_id long, line_no int, text string"
BY_LANGUAGE = (
    "q_split_pool_heldout q_slice_prefix q_tile_pool q_assemble q_assembly_report q_compression_rollup q_compression_blob q_crossing_pct q_encode_tokens_by_lang q_worst_lang "
    "q_config_vs_baseline q_training_curve q_spot_check q_one_stage_tokens q_sql_functions q_expansion_by_lang q_marker_fraction q_script_filter_stats q_line_examples"
).split()


@pytest.fixture(scope="module")
def without(spark, sf_dir, tmp_path_factory):
    """The tables, with a language taken from every fifth document."""
    folder = tmp_path_factory.mktemp("nulls")
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{sf_dir}/{t}.parquet", folder / f"{t}.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang"))).toPandas().to_parquet(folder / "documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def db(without):
    return connect(without)


@pytest.mark.parametrize("name", BY_LANGUAGE)
def test_query_with_null_languages(spark, without, db, name):
    want = db.execute(catalog.ORACLES[name]).df()
    assert rows(catalog.QUERIES[name](spark, without).toPandas()) == rows(want)


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([("a", 1, 0, "to be or"), ("a", 2, 0, "not to be"), (None, 3, 0, "that is"), (None, 4, 0, "the question"), (None, 4, 0, "another of the same place")], LINE)


def test_split_and_slice_keep_them(spark, lines):
    assert mixing.split_pool(lines).count() == 5
    targets = spark.createDataFrame([("a", 4), (None, 9)], "lang string, target long")
    got = sorted((r.lang or "", r.text) for r in mixing.slice_or_tile(lines, targets).collect())
    assert got == [("", "a"), ("", "that is"), ("a", "to b")]
    assert {r.lang for r in mixing.assemble(lines, targets).collect()} == {"a", None}
    assert {(r.lang, r.upsampled) for r in mixing.assembly_report(lines, targets).collect()} == {("a", False), (None, False)}


def test_equal_places_are_ordered_by_text(spark, lines):
    starts = {r.text: r.start for n in (1, 3) for r in mixing.offsets(lines.repartition(n), 4).where("doc_id = 4").collect()}
    assert starts == {"another of the same place": 8, "the question": 34}


def test_reports_tell_them_from_the_total(lines):
    m = train(lines, 3, 2, more=True)
    by = evaluate.compression(evaluate.token_stats(lines, m)).collect()
    assert sorted((r.lang or "", r.total) for r in by) == [("", False), ("", True), ("a", False)]
    assert sum(r.tokens for r in by if not r.total) == next(r.tokens for r in by if r.total)
    found = evaluate.sweep(lines, {"x": m, "y": m.at(96)}, "x")
    document = evaluate.sweep_document(found)
    assert found.where("lang = 'BLENDED'").count() == 2 and document["results"]["x"].keys() == {"a", None} and document["blended"].keys() == {"x", "y"}
    whole = next(r.tokens_per_char for r in by if r.total)
    points = evaluate.curve_document(evaluate.training_curve(lines, lines, m, [len(m.strings)]))
    assert points[0]["train_tokens_per_char"] == points[0]["heldout_tokens_per_char"] == whole and points[0]["train_per_lang"].keys() == {"a", None}
