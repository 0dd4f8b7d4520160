import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import mixing

GOLDEN = {
    "Amharic": (9490365420, 0.114701, 11470074, 493761),
    "Hausa": (686399711, 0.088205, 8820549, 8481297),
    "Yoruba": (646123521, 0.087674, 8767373, 1826536),
    "Xhosa": (112631838, 0.073621, 7362139, 7217783),
    "Luo": (870230, 0.045269, 4526904, 4526904),
    "Kanuri": (2635359, 0.050573, 5057337, 1991077),
    "Nama": (6249561, 0.055134, 5513443, 800209),
}


def test_shares(spark):
    rows = {r.name: r for r in mixing.shares(mixing.registry(spark), 0.10, 1e8).collect()}
    assert len(rows) == 13 and sum(r.share for r in rows.values()) == pytest.approx(1)
    for name, (natural, share, target, raw) in GOLDEN.items():
        r = rows[name]
        assert (round(r.natural_processed_chars), round(r.share, 6), round(r.target_processed), r.target_raw_chars) == (natural, share, target, raw)
    assert {n for n, r in rows.items() if r.repeat_factor > 1} == {"Luo", "Kanuri"}
    assert rows["Luo"].note == "MUST repeat"
    assert mixing.registry(spark, zulu=True).count() == 14


def test_no_download_is_infinite(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 1.0, True), ("b", 10, 1.0, 1.0, False)], mixing.REGISTRY)
    assert mixing.shares(df, 1.0, 10).where("name = 'a'").first().repeat_factor == float("inf")


def lines(spark, text, lang="x"):
    return spark.createDataFrame([(lang, 0, i, t) for i, t in enumerate(text.split("\n"))], "lang string, doc_id long, line_no int, text string")


def test_split_at_next_line_end(spark):
    parts = [r.part for r in mixing.split_pool(lines(spark, "aaaa\nbbbb\ncccc\n")).orderBy("line_no").collect()]
    assert parts == ["pool", "pool", "pool", "heldout"]


@pytest.mark.parametrize("target,seam,want", [(4, "fuse", "ab\nc"), (8, "fuse", "ab\ncdab\n"), (5, "fuse", "ab\ncd"), (11, "newline", "ab\ncd\nab\ncd"), (13, "fuse", "ab\ncdab\ncdab\n"[:13])])
def test_slice_and_tile(spark, target, seam, want):
    pool = lines(spark, "ab\ncd")
    out = mixing.slice_or_tile(pool, spark.createDataFrame([("x", target)], "lang string, target long"), seam)
    got, glue = "", ""
    for r in out.orderBy("copy", "line_no").collect():
        got += glue + r.text
        glue = "" if r.fused else "\n"
    assert got == want.rstrip("\n") or got + "\n" == want


def test_offsets_equal_a_running_sum(spark, sf_dir):
    from corpusloom.sources.text import document_lines

    for ranges in (None, 1, 50):
        at = mixing.offsets(document_lines(spark, sf_dir, "all"), ranges).orderBy("lang", "doc_id", "line_no").collect()
        start, lang = 0, None
        for r in at:
            start = 0 if r.lang != lang else start
            lang = r.lang
            assert r.start == start
            start += len(r.text) + 1


def test_no_task_has_a_language(spark, sf_dir):
    """Windows and shuffles of lines are by language and range, never by language alone."""
    from corpusloom.plans.corpus import q_assemble, q_expansion_by_lang, q_split_pool_heldout, q_tile_pool

    for q in (q_split_pool_heldout, q_tile_pool, q_assemble, q_expansion_by_lang):
        plan = q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "collect_set" not in plan
        assert all(x == "range" for x in re.findall(r"windowspecdefinition\(lang#\d+, (\w+)#", plan))


def test_coverage(spark):
    rows = {r.lang: r for r in mixing.coverage_supplement(mixing.coverage(spark), 40).collect()}
    assert rows["Amharic"].num_codepoints == 358 and rows["Somali"].supplement == ""
    assert rows["Kanuri"].supplement.startswith("aŋb ŋa ŋŋ aŋb")
    m = {r.char: r for r in mixing.coverage_manifest(spark).where(F.col("lang") == "Hausa").collect()}
    assert m["ɓ"].char_escaped == "\\u0253" and m["ɓ"].marker == "[U+0253 LATIN SMALL LETTER B WITH HOOK]"


def test_empty(spark):
    none = lines(spark, "a").where("false")
    assert mixing.split_pool(none).count() == 0
    assert mixing.slice_or_tile(none, spark.createDataFrame([("x", 5)], "lang string, target long")).count() == 0
