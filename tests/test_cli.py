import json

import pytest

from corpusloom.cli import main, parser
from corpusloom.operators.bpe.codec import Tokenizer


def read(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def test_filters(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("one\nгде это\n\ntwo é\n", encoding="utf-8")
    main(["filter_script_contamination", f"{tmp_path}/in.txt", f"{tmp_path}/kept"])
    assert sorted(read(spark, tmp_path / "kept")) == ["", "one", "two é"] and "CYRILLIC" in capsys.readouterr().out
    (tmp_path / "langs").mkdir()
    (tmp_path / "langs/en.txt").write_text("the cat and the dog were there with the other\n" * 3)
    (tmp_path / "langs/xx.txt").write_text("zuq vizk qozz yuqq zavq\n" * 3)
    main(["train_langid", f"{tmp_path}/langs", f"{tmp_path}/scorer.json"])
    (tmp_path / "mixed.txt").write_text("the dog and the cat\nzuq qozz zavq yuqq\n\n")
    main(["filter_langid_contamination", f"{tmp_path}/mixed.txt", f"{tmp_path}/same", "--model", f"{tmp_path}/scorer.json", "--threshold", "2"])
    assert len(read(spark, tmp_path / "same")) == 3
    main(["filter_langid_contamination", f"{tmp_path}/mixed.txt", f"{tmp_path}/none", "--model", f"{tmp_path}/scorer.json"])
    assert read(spark, tmp_path / "none") == [""]


def test_mixing_and_coverage(spark, tmp_path, capsys):
    from corpusloom.operators.mixing import LANGUAGES

    main(["compute_mixing_ratios", "--alpha", "0.1", "--total-processed-chars", "1e8"])
    assert "493,761" in capsys.readouterr().out
    for name, *_ in LANGUAGES:
        (tmp_path / f"{name.lower().replace(' ', '_')}.txt").write_text("some text é\nmore of it\n" * 3, encoding="utf-8")
    main(["assemble_pilot_corpus", "--alpha", "0.1", "--total-processed-chars", "2000", "--source-dir", str(tmp_path), "--out-dir", f"{tmp_path}/out"])
    combined = read(spark, tmp_path / "out/combined_train")
    assert combined and all(x.isascii() for x in combined) and len(read(spark, tmp_path / "out/by_language/lang=luo")) > 1
    (tmp_path / "luo.txt").unlink()
    with pytest.raises(FileNotFoundError):
        main(["assemble_pilot_corpus", "--alpha", "0.1", "--source-dir", str(tmp_path), "--out-dir", f"{tmp_path}/out"])
    main(["analyze_marker_coverage", "--dir", str(tmp_path), "--sample-chars", "40"])
    assert "LATIN SMALL LETTER E WITH ACUTE" in capsys.readouterr().out
    main(["enumerate_script_coverage", "--write", f"{tmp_path}/coverage", "--repeats", "2"])
    assert len(json.loads((tmp_path / "coverage/manifest.json").read_text())) > 400
    main(["fetch_samples", f"{tmp_path}/xhosa.txt", f"{tmp_path}/head", "--bytes", "20"])
    assert read(spark, tmp_path / "head") == ["some text é"]


def test_training_and_evaluation(spark, tmp_path, capsys):
    text = "to be or not to be\nto be is to do\n" * 5
    for d, suffix in (("held", "_heldout_processed.txt"), ("train", "_train_sample.txt")):
        (tmp_path / d).mkdir()
        (tmp_path / d / f"en{suffix}").write_text(text)
    (tmp_path / "corpus.txt").write_text(text)
    out = f"{tmp_path}/m.json"
    main(["train_superbpe_pilot", f"{tmp_path}/corpus.txt", out, "--stage1-vocab-size", "99", "--vocab-size", "103", "--snapshot-dir", f"{tmp_path}/snaps", "--snapshot-every", "100"])
    main(["train_bpe_pilot", f"{tmp_path}/corpus.txt", f"{tmp_path}/b.json", "--vocab-size", "99"])
    assert (tmp_path / "snaps/100.json").exists() and (tmp_path / "m.checkpoints/stage2.json").exists()
    main(["collect_training_curve", out, "--snapshot-every", "99", "--heldout-dir", f"{tmp_path}/held", "--train-sample-dir", f"{tmp_path}/train", "--out", f"{tmp_path}/curve.json"])
    curve = json.loads((tmp_path / "curve.json").read_text())
    assert [p["vocab_size"] for p in curve] == [99, 103] and curve[0]["heldout_tokens_per_char"] > curve[1]["heldout_tokens_per_char"]
    main(["evaluate_pilot", out, f"{tmp_path}/b.json", "--heldout-dir", f"{tmp_path}/held", "--out", f"{tmp_path}/sweep.json"])
    assert set(json.loads((tmp_path / "sweep.json").read_text())["blended"]) == {out, f"{tmp_path}/b.json"}
    main(["evaluate_superbpe_pilot", out, "--heldout-dir", f"{tmp_path}/held"])
    main(["validate_submission", out, "--heldout-dir", f"{tmp_path}/held"])
    assert "[OK] passed" in capsys.readouterr().out
    (tmp_path / "mirrors.json").write_text('{"en": "asks"}')
    main(["evaluate_tier2", out, "--dir", f"{tmp_path}/held", "--suffix", "_heldout_processed.txt", "--mirrors", f"{tmp_path}/mirrors.json"])
    said = capsys.readouterr().out
    assert "asks" in said and "ALL" in said
    main(["vocabulary_diff", out, f"{tmp_path}/b.json", "--containing", "", "--dir", f"{tmp_path}/held", "--suffix", "_heldout_processed.txt"])
    said = capsys.readouterr().out
    assert "lost" in said and "same_tokens" in said and "to | be" not in said and "|" in said
    main(["encode_file", out, f"{tmp_path}/corpus.txt", f"{tmp_path}/ids"])
    t = Tokenizer(out)
    ids = t.encode(["to be is to do", ""])
    assert " ".join(map(str, ids[0])) in read(spark, tmp_path / "ids") and t.decode(ids) == ["to be is to do", ""]


def test_options_have_the_documented_defaults():
    a = parser().parse_args(["train_superbpe_pilot", "c", "o"])
    assert (a.stage1_vocab_size, a.vocab_size, a.checkpoint_every, a.snapshot_every, a.max_span_words, a.merge_criterion, a.pmi_min_count, a.pmi_rebuild_every) == (12000, 20000, 500, 1000, None, "frequency", 5, 300)
