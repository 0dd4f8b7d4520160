import pytest
from pyspark.sql import functions as F

from corpusloom.functions import langid, scripts

CASES = [
    ("abc где", "CYRILLIC"),
    ("abc гд", None),
    ("аб αβ", None),
    ("аб αβγ где", "CYRILLIC"),
    ("аб αβγ", "GREEK"),
    ("αβγ где", "GREEK"),
    ("ሀሁሂሃ", None),
    ("", None),
    ("日本語 text", "CJK"),
    ("ひらがな", "HIRAGANA"),
    ("ә̀ә̀ә̀", "CYRILLIC"),
    (None, None),
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([("xx", 1, i, t) for i, (t, _) in enumerate(CASES)], "lang string, doc_id long, line_no int, text string")


def test_reasons(lines):
    got = dict(map(tuple, lines.select("line_no", scripts.contamination(F.col("text"))).collect()))
    assert got == {i: r for i, (_, r) in enumerate(CASES)}


def test_profile_changes_nothing_but_strict_does(lines):
    pick = lambda **k: [r[0] for r in lines.orderBy("line_no").select(scripts.contamination(F.col("text"), **k)).collect()]
    assert pick(profile="ethiopic") == pick()
    assert pick(strict=True)[6] == "ETHIOPIC" and pick(profile="ethiopic", strict=True)[6] is None
    assert pick(least=2)[1] == "CYRILLIC"


def test_stats_and_examples(lines):
    row = scripts.filter_stats(lines.where("text IS NOT NULL")).first()
    assert (row.total_lines, row.dropped_lines) == (11, 7)
    assert row.total_chars == sum(len(t) + 1 for t, _ in CASES if t is not None)
    kept, dropped = scripts.filter_lines(lines)
    assert kept.count() + dropped.count() == len(CASES)
    assert scripts.examples(dropped, 2).count() == 2
    assert scripts.drop_reasons(lines).first().reason == "CYRILLIC"


def test_langid(spark):
    rows = [("a line", "en", 0.9), ("a line", "eo", 0.9), ("a line", "en", 0.4), ("  ", "en", 0.9), ("x", None, None), ("y", "fr", 0.5)]
    df = spark.createDataFrame(rows, "text string, label string, prob double")
    kept = [r[0] for r in df.select(langid.kept(df.text, df.label, df.prob)).collect()]
    assert kept == [False, True, True, True, True, False]
    assert tuple(langid.report(df).first()) == (6, 2, pytest.approx(100 * 2 / 6))
    assert [tuple(r) for r in langid.dropped_by_label(df).collect()] == [("en", 1), ("fr", 1)]


def test_trained_scorer(spark, sf_dir):
    from corpusloom.sources.text import document_lines

    lines = document_lines(spark, sf_dir)
    model = langid.train_scorer(lines, per_label=100)
    scored = langid.score(lines.where("length(text) > 60"), model)
    right = scored.agg(F.avg((F.col("lang") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.9
    assert langid.score_text(model, " ") == (None, 0.0)


def test_any_scorer(spark):
    def loaded():
        return lambda t: ("xx" if "x" in t else "yy", 0.75)

    df = spark.createDataFrame([("x",), ("b",), (None,)], "text string")
    assert [tuple(r) for r in langid.score(df, loaded).select("label", "prob").collect()] == [("xx", 0.75), ("yy", 0.75), (None, 0.0)]


def test_filters_judge_each_line_once(spark, tmp_path):
    """Lines kept, counts, reasons and examples come from one pass: each line meets the scorer, and what is in front of the filter, once."""
    from corpusloom.functions import langid, scripts
    from corpusloom.session import written

    log = tmp_path / "met"
    rows = [("x", i, 0, t) for i, t in enumerate(["one", "где это", "ещё раз γδε", "", None, "двa", "two"] * 5)]
    lines = spark.createDataFrame(rows, "lang string, doc_id long, line_no int, text string").repartition(3)

    def scorer():
        def of(text):
            with open(log, "a") as f:
                f.write("x\n")
            return ("ru" if "г" in text else "en"), 0.9

        return of

    judged, tally = langid.judged_once(lines, scorer)
    judged = written(judged)
    assert judged.count() == 35 and tally.get() == {"total": 35, "dropped": 25}
    assert langid.dropped_by_label(judged).count() == 2 and len(log.read_text().split()) == 30  # null meets no scorer
    judged, tally = scripts.judged_once(lines)
    judged = written(judged)
    for _ in range(2):
        assert scripts.tally_reasons(tally) == [(r.reason, r.n) for r in scripts.drop_reasons(lines).collect()] == [("CYRILLIC", 10)]
    want = scripts.filter_stats(lines.where("text IS NOT NULL")).drop("lang").first().asDict()
    got = scripts.tally_stats(tally)
    assert got["total_lines"] == 35 and got["dropped_chars"] == want["dropped_chars"] and got["pct_chars"] == want["pct_chars"]
    assert judged.where("reason IS NULL").count() == 25


def test_batches_are_scored_as_single_texts():
    model = {"en": {"t": -1.5, "th": -2.0, " th": -2.5, "e ": -2.25}, "de": {"t": -1.75, "ch": -2.0, "ü": -3.0, "ich": -2.5}, "da": {"t": -1.75, "ch": -2.0, "ü": -3.0, "ich": -2.5}}
    texts = ["The thing", None, "", " \t ", "ich möchte über", "zzz", "t", "\U0001f600 the", "X" * 50, "Ǆ İ the the"] * 3
    for together in (1, 7, 1 << 20):
        scorer = langid.BatchScorer(model)
        scorer.together = together
        for table in (scorer.place, None):
            scorer.place = table
            label, prob = scorer(texts)
            want = [langid.score_text(model, t) if t is not None else (None, 0.0) for t in texts]
            assert label == [w[0] for w in want] and prob.tolist() == pytest.approx([w[1] for w in want])
    assert langid.BatchScorer({})(["a"])[0] == [None] and langid.BatchScorer({"xx": {}})(["a"])[0] == ["xx"]


def test_batches_count_no_text_by_itself(monkeypatch):
    monkeypatch.setattr(langid, "_grams", lambda text: pytest.fail("one text at a time"))
    assert langid.BatchScorer({"en": {"th": -1.0}, "de": {"ch": -1.0}})(["ach"])[0] == ["en"]
