"""The operators as commands. Files may be in any store that Spark reads; results are printed as tables, and written where a path is given."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import langid, scripts
from .operators import align, evaluate, mixing, profile
from .operators.bpe import distributed
from .operators.bpe.codec import encode
from .operators.bpe.model import Model
from .plans.report import fixed_width
from .session import session, written
from .sources import sinks
from .sources.text import coverage_slug, file_lines, head_bytes, read_dir_lines, slug, sourced, trimmed_to_line


def _lines(read: DataFrame, lang) -> DataFrame:
    """Lines of files in the order of their place, under the column names of the operators."""
    return read.select(lang.alias("lang"), F.col("block").alias("doc_id"), F.col("at").alias("line_no"), "text")


def _file(spark: SparkSession, path: str) -> DataFrame:
    return _lines(file_lines(spark, path), F.lit(path))


def _dir(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    return _lines(read_dir_lines(spark, folder, suffix), F.col("lang")).where("text <> ''")


def _corpus(spark: SparkSession, path: str) -> DataFrame:
    return file_lines(spark, path).select("text").where("text <> ''")


def compute_mixing_ratios(spark, a) -> None:
    out = mixing.shares(mixing.registry(spark, a.zulu), a.alpha, a.total_processed_chars)
    print(fixed_width(out.select("name", "natural_processed_chars", "share", "target_processed", "target_raw_chars", "repeat_factor", "note")))


def assemble_pilot_corpus(spark, a) -> None:
    plan = mixing.shares(mixing.registry(spark, a.zulu), a.alpha, a.total_processed_chars)
    names = sourced(plan, a.source_dir).select(slug(F.col("name")).alias("lang"), "path")
    lines = _dir(spark, a.source_dir, ".txt").join(F.broadcast(names.select("lang")), "lang", "left_semi")
    targets = plan.select(slug(F.col("name")).alias("lang"), F.col("target_raw_chars").alias("target"))
    print(fixed_width(mixing.assembly_report(lines, targets)))
    out = mixing.assemble(lines, targets)
    sinks.write_corpus(out, f"{a.out_dir}/by_language")
    sinks.write_combined(out, f"{a.out_dir}/combined_train", "lang", "copy", "doc_id", "line_no")


def filter_script_contamination(spark, a) -> None:
    lines, tally = scripts.judged_once(_file(spark, a.input), a.script, a.min_foreign_chars)
    judged = written(lines)  # the one scan of the input; what follows reads this table
    sinks.write_combined(judged.where("reason IS NULL"), a.output, "doc_id", "line_no")
    print(fixed_width(spark.createDataFrame([scripts.tally_stats(tally)], "total_lines long, dropped_lines long, total_chars long, dropped_chars long, pct_lines double, pct_chars double")))
    print(fixed_width(spark.createDataFrame(scripts.tally_reasons(tally), "reason string, n long")))
    print(fixed_width(scripts.examples(judged.where("reason IS NOT NULL"))))


def _scorer(name: str):
    """A scorer from a document of log probabilities by label, or module:function, a function that loads one."""
    if name.endswith(".json"):
        return sinks.read_json(name)
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def filter_langid_contamination(spark, a) -> None:
    lines, tally = langid.judged_once(_file(spark, a.input), _scorer(a.model), a.threshold)
    judged = written(lines)  # the one scan of the input, in which each line is scored; what follows reads this table
    sinks.write_combined(judged.where("NOT gone"), a.output, "doc_id", "line_no")
    n = tally.get()
    print(fixed_width(spark.createDataFrame([(n["total"], n["dropped"], 100.0 * n["dropped"] / max(n["total"], 1))], "total long, dropped long, pct double")))
    print(fixed_width(langid.dropped_by_label(judged, a.threshold)))
    print(fixed_width(scripts.examples(judged.where("gone").withColumn("reason", F.col("label")), a.show_examples)))


def train_langid(spark, a) -> None:
    sinks.atomic_json(a.out, langid.train_scorer(_dir(spark, a.dir, a.suffix)))


def analyze_marker_coverage(spark, a) -> None:
    parts = [_file(spark, f) for f in a.files] + ([_dir(spark, a.dir, ".txt")] if a.dir else [])
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    sample = mixing.slice_or_tile(lines, lines.select("lang").distinct().withColumn("target", F.lit(a.sample_chars).cast("long"))).where("copy = 0")
    print(fixed_width(profile.expansion(sample)))
    print(fixed_width(profile.top_markers(sample)))


def enumerate_script_coverage(spark, a) -> None:
    out = mixing.coverage_supplement(mixing.coverage(spark), a.repeats)
    print(fixed_width(out.select("lang", "family", "confidence", "num_codepoints")))
    if a.write:
        named = out.select(coverage_slug(F.col("lang")).alias("lang"), F.col("supplement").alias("text")).where("text <> ''")
        named.write.mode("overwrite").partitionBy("lang").text(f"{a.write}/supplement")
        rows = [r.asDict() for r in mixing.coverage_manifest(spark).collect()]  # the registry's code points
        sinks.atomic_json(f"{a.write}/manifest.json", rows)


def train_superbpe_pilot(spark, a) -> None:
    how = {"max_span_words": a.max_span_words, "criterion": a.merge_criterion, "pmi_min_count": a.pmi_min_count, "pmi_rebuild_every": a.pmi_rebuild_every}
    marks = f"{a.out.removesuffix('.json')}.checkpoints" if a.checkpoint_every else None
    m = distributed.train(_corpus(spark, a.corpus), a.stage1_vocab_size, a.vocab_size, marks, a.checkpoint_every, **how)
    m.save(a.out)
    for size in range(a.snapshot_every, len(m.strings), a.snapshot_every) if a.snapshot_dir else ():
        if size > 95:
            m.at(size).save(f"{a.snapshot_dir}/{size}.json")
    print(f"{len(m.stage1)} and {len(m.stage2)} merges, vocabulary of {len(m.strings)}: {a.out}")


def train_bpe_pilot(spark, a) -> None:
    m = distributed.train_words(_corpus(spark, a.corpus), a.vocab_size)
    m.save(a.out)
    print(f"{len(m.stage1)} merges, vocabulary of {len(m.strings)}: {a.out}")


def collect_training_curve(spark, a) -> None:
    m = Model.load(a.model)
    sizes = [*range(a.snapshot_every, len(m.strings), a.snapshot_every), len(m.strings)]
    curve = evaluate.training_curve(_dir(spark, a.train_sample_dir, "_train_sample.txt"), _dir(spark, a.heldout_dir, "_heldout_processed.txt"), m, [s for s in sizes if s >= 95])
    points = evaluate.curve_document(curve)
    sinks.atomic_json(a.out, points)
    for p in points:
        print(p["stage"], p["vocab_size"], p["train_tokens_per_char"], p["heldout_tokens_per_char"])


def evaluate_pilot(spark, a) -> None:
    models = {p: Model.load(p) for p in a.tokenizer_paths}
    lines = _dir(spark, a.heldout_dir, "_heldout_processed.txt")
    out = evaluate.sweep(lines, models, a.tokenizer_paths[0], "line")
    print(fixed_width(out))
    if a.out:
        sinks.atomic_json(a.out, evaluate.sweep_document(out))


def evaluate_superbpe_pilot(spark, a) -> None:
    m, lines = Model.load(a.model), _dir(spark, a.heldout_dir, "_heldout_processed.txt")
    print(fixed_width(evaluate.compression(evaluate.token_stats(lines, m))))
    print(fixed_width(evaluate.spot_check(lines, m).groupBy("lang").agg(F.count("*").alias("lines"), F.bool_and("same").alias("same"))))


def evaluate_tier2(spark, a) -> None:
    """Compression of languages that the vocabulary was not learned from, each with what it mirrors (a JSON document of names), if that is known."""
    by = evaluate.compression(evaluate.token_stats(_dir(spark, a.dir, a.suffix), Model.load(a.model)))
    mirrors = sinks.read_json(a.mirrors) if a.mirrors else {}
    names = spark.createDataFrame([(k, v) for k, v in mirrors.items()], "lang string, mirror string")
    out = mixing.with_language(by, names, "left").withColumn("mirror", F.coalesce("mirror", F.lit("")))
    print(fixed_width(out.orderBy("total", "lang").select(F.when(F.col("total"), "ALL").otherwise(F.col("lang")).alias("lang"), "mirror", "tokens", "chars", "tokens_per_char", "crossing_pct")))


def vocabulary_diff(spark, a) -> None:
    """Symbols that one model has and the other lacks, and with texts how their tokens differ over all of them."""
    old, new = Model.load(a.old), Model.load(a.new)
    print(fixed_width(evaluate.vocabulary_diff(*(m.tables(spark)[0].select("str") for m in (old, new)), k=a.most, containing=a.containing)))
    if a.dir:
        lines = _dir(spark, a.dir, a.suffix)
        print(fixed_width(align.alignment(lines, old, new, "lang").orderBy("lang")))
        print(fixed_width(align.replacements(lines, old, new, a.most)))


def validate_submission(spark, a) -> None:
    lines = _dir(spark, a.heldout_dir, "_heldout_processed.txt") if a.heldout_dir else None
    m = Model.load(a.model)
    checks = evaluate.validate(m, lines=lines)
    for k, v in checks.items():
        print(f"[{'OK' if v else 'FAIL'}] {k}")
    if lines is not None:
        print(evaluate.throughput(spark, lines, m))
    if not checks["passed"]:
        raise SystemExit(1)


def fetch_samples(spark, a) -> None:
    head = head_bytes(spark, a.source, a.bytes).select("path", trimmed_to_line(F.make_valid_utf8(F.col("head").cast("string"))).alias("text"))
    head.select("text").write.mode("overwrite").text(a.out)
    print(fixed_width(head.select("path", F.octet_length("text").alias("bytes"), (F.regexp_count("text", F.lit("\n")) + 1).alias("lines"))))


def encode_file(spark, a) -> None:
    out = encode(file_lines(spark, a.input), Model.load(a.model))
    out.orderBy("path", "block", "at").select(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("value")).write.mode("overwrite").text(a.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(f, *positional: str) -> argparse.ArgumentParser:
        p = sub.add_parser(f.__name__, help=f.__doc__)
        p.set_defaults(run=f)
        for x in positional:
            p.add_argument(x)
        return p

    p = command(compute_mixing_ratios)
    p.add_argument("--alpha", type=float, default=0.3)
    p.add_argument("--total-processed-chars", type=float, default=3e8)
    p.add_argument("--zulu", action="store_true")
    p = command(assemble_pilot_corpus)
    p.add_argument("--alpha", type=float, required=True)
    p.add_argument("--total-processed-chars", type=float, default=15e6)
    p.add_argument("--source-dir", required=True)
    p.add_argument("--out-dir", required=True)
    p.add_argument("--zulu", action="store_true")
    p = command(filter_script_contamination, "input", "output")
    p.add_argument("--script", choices=sorted(scripts.PROFILES), default="latin")
    p.add_argument("--min-foreign-chars", type=int, default=3)
    p = command(filter_langid_contamination, "input", "output")
    p.add_argument("--model", required=True)
    p.add_argument("--threshold", type=float, default=0.5)
    p.add_argument("--show-examples", type=int, default=10)
    p = command(train_langid, "dir", "out")
    p.add_argument("--suffix", default=".txt")
    p = command(analyze_marker_coverage)
    p.add_argument("files", nargs="*")
    p.add_argument("--dir")
    p.add_argument("--sample-chars", type=int, default=2_000_000)
    p = command(enumerate_script_coverage)
    p.add_argument("--write")
    p.add_argument("--repeats", type=int, default=40)
    p = command(train_superbpe_pilot, "corpus", "out")
    p.add_argument("--stage1-vocab-size", type=int, default=12_000)
    p.add_argument("--vocab-size", type=int, default=20_000)
    p.add_argument("--checkpoint-every", type=int, default=500)
    p.add_argument("--snapshot-dir")
    p.add_argument("--snapshot-every", type=int, default=1000)
    p.add_argument("--max-span-words", type=int)
    p.add_argument("--merge-criterion", choices=["frequency", "pmi"], default="frequency")
    p.add_argument("--pmi-min-count", type=int, default=5)
    p.add_argument("--pmi-rebuild-every", type=int, default=300)
    p = command(train_bpe_pilot, "corpus", "out")
    p.add_argument("--vocab-size", type=int, default=20_000)
    p = command(collect_training_curve, "model")
    p.add_argument("--snapshot-every", type=int, default=1000)
    p.add_argument("--heldout-dir", required=True)
    p.add_argument("--train-sample-dir", required=True)
    p.add_argument("--out", required=True)
    p = command(evaluate_pilot)
    p.add_argument("tokenizer_paths", nargs="+")
    p.add_argument("--heldout-dir", required=True)
    p.add_argument("--out")
    p = command(evaluate_superbpe_pilot, "model")
    p.add_argument("--heldout-dir", required=True)
    p = command(evaluate_tier2, "model")
    p.add_argument("--dir", required=True)
    p.add_argument("--suffix", default=".txt")
    p.add_argument("--mirrors")
    p = command(vocabulary_diff, "old", "new")
    p.add_argument("--containing", default="[U+")
    p.add_argument("--most", type=int, default=25)
    p.add_argument("--dir")
    p.add_argument("--suffix", default=".txt")
    p = command(validate_submission, "model")
    p.add_argument("--heldout-dir")
    p = command(fetch_samples, "source", "out")
    p.add_argument("--bytes", type=int, default=5_000_000)
    command(encode_file, "model", "input", "output")
    return top


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.getActiveSession() or session(), a)
