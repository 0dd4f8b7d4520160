"""The registered queries: each operator on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import langid, scripts
from ..functions.normalize import normalize
from ..operators import align, counts, evaluate, mixing, profile
from ..functions.register import register
from ..operators.bpe import codec
from ..operators.bpe.checkpoint import Checkpoint
from ..operators.bpe.dictionary import encode_by_words
from ..operators.bpe.distributed import learn_units, train, train_words
from ..operators.bpe.model import Model, Symbols
from ..session import discarded, scratch, written
from ..sources import sinks
from ..sources.text import coverage_slug, document_lines, file_lines, lines, sample_jobs, sample_size, source_registry, table, trimmed_to_line
from ..streaming.lines import event_counts

MERGES_1, MERGES_2 = 30, 20
#: Characters of each language, the null one among them.
TARGETS = (("de", 20_000), ("en", 50_000), ("es", 10_000), ("fr", 1_000_000), (None, 30_000))
_MODELS: dict[str, Model] = {}


def model_of(spark: SparkSession, sf_dir: str) -> Model:
    """The vocabulary that the encoding queries share, learned from the lines of a table once in a process."""
    if sf_dir not in _MODELS:
        _MODELS[sf_dir] = train(document_lines(spark, sf_dir), MERGES_1, MERGES_2, more=True)
    return _MODELS[sf_dir]


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in which some letters became Cyrillic, so that the script filter has something to find."""
    return document_lines(spark, sf_dir, "all").withColumn("text", F.translate("text", "üöäß", "жшщю"))


def q_lines_nonempty(spark, sf_dir):
    return document_lines(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


def q_word_freq_top(spark, sf_dir):
    return counts.word_freq(document_lines(spark, sf_dir)).orderBy(F.desc("freq"), "unit").limit(100)


def q_line_freq(spark, sf_dir):
    return counts.line_freq(document_lines(spark, sf_dir)).where("freq > 1")


def q_pair_counts_top(spark, sf_dir):
    return counts.pair_counts(counts.word_freq(document_lines(spark, sf_dir))).orderBy(F.desc("n"), "a", "b").limit(100)


def q_symbol_counts(spark, sf_dir):
    return counts.symbol_counts(counts.word_freq(document_lines(spark, sf_dir)))


def q_fingerprint(spark, sf_dir):
    return counts.fingerprint(counts.word_freq(document_lines(spark, sf_dir))).select("fingerprint")


def q_normalize_lines(spark, sf_dir):
    return document_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), normalize(F.col("text")).alias("text"))


def q_normalize_mixed(spark, sf_dir):
    """Lines in which some letters became those of other scripts, combining marks and punctuation."""
    lines = document_lines(spark, sf_dir).withColumn("text", F.translate("text", "üöäßéñó", "ሀж።“\u0301ǃ…"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), normalize(F.col("text")).alias("text"))


def q_expansion_by_lang(spark, sf_dir):
    return profile.expansion(document_lines(spark, sf_dir)).select("lang", "raw_chars", "processed_chars", "expansion_factor")


def q_marker_fraction(spark, sf_dir):
    return profile.expansion(document_lines(spark, sf_dir)).select("lang", "unique_markers", "marker_char_fraction")


def q_marker_counts(spark, sf_dir):
    return profile.marker_counts(document_lines(spark, sf_dir)).select("lang", "marker", "n")


def q_markers_top15(spark, sf_dir):
    return profile.top_markers(document_lines(spark, sf_dir)).select("lang", F.col("rank").cast("long").alias("rank"), "marker", "n")


def q_markers_rare(spark, sf_dir):
    return profile.rare_markers(document_lines(spark, sf_dir)).select("lang", "marker", "n")


def q_script_filter_stats(spark, sf_dir):
    return scripts.filter_stats(injected(spark, sf_dir))


def q_script_filter_kept(spark, sf_dir):
    kept, _ = scripts.filter_lines(injected(spark, sf_dir))
    return kept.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text")


def q_script_drop_reasons(spark, sf_dir):
    return scripts.drop_reasons(injected(spark, sf_dir))


def q_script_filter_once(spark, sf_dir):
    """The filter's figures over all languages, taken while the judged lines are written; the lines it keeps are counted in what was written."""
    lines, tally = scripts.judged_once(injected(spark, sf_dir))
    kept = written(lines).where("reason IS NULL").agg(F.count("*").alias("kept_lines"), F.sum(F.length("text")).alias("kept_chars"))
    stats, reasons = scripts.tally_stats(tally), scripts.tally_reasons(tally)
    more = [F.lit(v).alias(k) for k, v in stats.items()] + [F.lit(",".join(f"{k}:{n}" for k, n in reasons)).alias("reasons")]
    return kept.select("kept_lines", "kept_chars", *[c if "pct" in k else c.cast("long").alias(k) for c, k in zip(more, [*stats], strict=False)], more[-1])


def _scored(spark, sf_dir):
    """Lines with their language as label and a probability by their length."""
    prob = F.pmod(F.length("text") * 37, F.lit(100)) / 100
    return document_lines(spark, sf_dir, "all").withColumn("label", F.when(F.col("lang") == "es", "eo").otherwise(F.col("lang"))).withColumn("prob", prob)


def q_langid_filter(spark, sf_dir):
    return langid.report(_scored(spark, sf_dir))


def q_langid_dropped(spark, sf_dir):
    return langid.dropped_by_label(_scored(spark, sf_dir))


def q_langid_trained(spark, sf_dir):
    """Documents' lines by the label that the trained scorer gives them."""
    lines = document_lines(spark, sf_dir)
    return langid.score(lines, langid.train_scorer(lines)).groupBy("lang", "label").agg(F.count("*").alias("n"))


def q_mix_shares(spark, sf_dir):
    return mixing.shares(mixing.registry(spark), 0.1, 1e8).select("name", F.round("natural_processed_chars", 3).alias("natural_processed_chars"), F.round("share", 9).alias("share"))


def q_mix_targets(spark, sf_dir):
    return mixing.shares(mixing.registry(spark, zulu=True), 0.1, 1e8).select("name", F.round("target_processed", 3).alias("target_processed"), "target_raw_chars")


def q_upsample_notes(spark, sf_dir):
    return mixing.shares(mixing.registry(spark), 0.1, 1e8).select("name", F.round("repeat_factor", 6).alias("repeat_factor"), "note")


def q_split_pool_heldout(spark, sf_dir):
    at = mixing.split_pool(document_lines(spark, sf_dir, "all"))
    return at.select("lang", "doc_id", F.col("line_no").cast("long").alias("line_no"), "part")


def _targets(spark, factor: float):
    return spark.createDataFrame([(k, int(v * factor)) for k, v in TARGETS], "lang string, target long")


def _pool(spark, sf_dir):
    return document_lines(spark, sf_dir, "all")


def q_slice_prefix(spark, sf_dir):
    out = mixing.slice_or_tile(_pool(spark, sf_dir), _targets(spark, 0.5))
    return out.select("lang", "copy", "doc_id", F.col("line_no").cast("long").alias("line_no"), "text")


def q_tile_pool(spark, sf_dir):
    out = mixing.slice_or_tile(_pool(spark, sf_dir), _targets(spark, 2.5))
    return out.groupBy("lang").agg(F.count("*").alias("n_lines"), F.max("copy").alias("last_copy"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.col("fused").cast("long")).alias("n_fused"))


def q_assemble(spark, sf_dir):
    out = mixing.assemble(_pool(spark, sf_dir), _targets(spark, 1.0))
    return out.select("lang", "copy", "doc_id", F.col("line_no").cast("long").alias("line_no"), "text")


def q_coverage_supplement(spark, sf_dir):
    return mixing.coverage_supplement(mixing.coverage(spark), 2).select("lang", "num_codepoints", "supplement")


def q_coverage_union(spark, sf_dir):
    return mixing.coverage(spark).select(F.explode("codepoints").alias("c")).agg(F.count_distinct("c").alias("n_codepoints"))


def _merge_rows(spark, merges):
    return spark.createDataFrame([(r, *m) for r, m in enumerate(merges)], "rank long, a long, b long, new_id long")


def q_bpe_merges_50(spark, sf_dir):
    return _merge_rows(spark, learn_units(counts.word_freq(document_lines(spark, sf_dir)), 50, Symbols(), more=True))


def q_bpe_merges_distributed(spark, sf_dir):
    """The same with a shortlist that is cut off, proposals from a part of the words, and arrays that are rewritten on the way."""
    return _merge_rows(spark, learn_units(counts.word_freq(document_lines(spark, sf_dir)), 50, Symbols(), more=True, dealt={"shortlist": 256, "sample": 1 << 16, "rewrite": 20}))


def q_bpe_stage2_merges(spark, sf_dir):
    return _merge_rows(spark, model_of(spark, sf_dir).stage2)


def q_bpe_span_capped(spark, sf_dir):
    """Merges of whole lines that span two words at most."""
    return _merge_rows(spark, learn_units(counts.line_freq(document_lines(spark, sf_dir)), 20, Symbols(), more=True, max_span_words=2))


def q_pmi_merges(spark, sf_dir):
    """Merges by PMI among pairs of 500 or more, listed anew every 10."""
    merges = learn_units(counts.word_freq(document_lines(spark, sf_dir)), 30, Symbols(), more=True, criterion="pmi", pmi_min_count=500, pmi_rebuild_every=10)
    return _merge_rows(spark, merges)


def q_encode_lines(spark, sf_dir):
    stats = codec.encode(document_lines(spark, sf_dir), model_of(spark, sf_dir))
    return stats.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


def q_encode_by_words(spark, sf_dir):
    """Different lines by stage 1, from a table in which each different word was encoded once."""
    out = encode_by_words(counts.line_freq(document_lines(spark, sf_dir)), model_of(spark, sf_dir), as_chars=False)
    return out.select("unit", "freq", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


def q_encode_native(spark, sf_dir):
    """Encoding without Python: tokens by language."""
    lines = document_lines(spark, sf_dir).withColumn("ids", codec.encode_native(F.col("text"), model_of(spark, sf_dir)))
    return lines.groupBy("lang").agg(F.sum(F.size("ids")).alias("tokens"))


def _stats(spark, sf_dir):
    return evaluate.token_stats(document_lines(spark, sf_dir), model_of(spark, sf_dir))


def _named(total: str):
    return F.when(F.col("total"), total).otherwise(F.col("lang")).alias("lang")


def q_encode_tokens_by_lang(spark, sf_dir):
    return evaluate.compression(_stats(spark, sf_dir)).where("NOT total").select("lang", "tokens", "chars", "tokens_per_char")


def q_compression_blob(spark, sf_dir):
    return evaluate.compression(_stats(spark, sf_dir), "blob").where("NOT total").select("lang", "tokens", "chars", "tokens_per_char")


def q_crossing_pct(spark, sf_dir):
    return evaluate.compression(_stats(spark, sf_dir)).where("NOT total").select("lang", "crossing", "crossing_pct")


def q_compression_rollup(spark, sf_dir):
    return evaluate.compression(_stats(spark, sf_dir)).select(_named("ALL"), "tokens", "chars", "tokens_per_char")


def q_worst_lang(spark, sf_dir):
    return evaluate.worst_language(evaluate.compression(_stats(spark, sf_dir)))


def q_roundtrip(spark, sf_dir):
    out = evaluate.round_trip(document_lines(spark, sf_dir), model_of(spark, sf_dir))
    return out.select("n_lines", "n_chars", "n_mismatch", F.col("first_mismatch.doc_id").alias("first_doc"), F.col("first_mismatch.line_no").cast("long").alias("first_line"))


def q_codec_baseline(spark, sf_dir):
    lines = document_lines(spark, sf_dir).withColumn("ids", codec.encode_baseline(F.col("text")))
    back = codec.decode_baseline(F.col("ids"))
    return lines.groupBy("lang").agg(F.sum(F.size("ids")).alias("n_ids"), F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda a, i: a + i)).alias("sum_ids"), F.sum((back != F.col("text")).cast("long")).alias("n_mismatch"))


def q_config_vs_baseline(spark, sf_dir):
    m = model_of(spark, sf_dir)
    return evaluate.sweep(document_lines(spark, sf_dir), {"base": m, "words": Model(m.strings, m.stage1, []), "half": m.at(len(m.strings) - MERGES_2 - MERGES_1 // 2)}, "base", "line").drop("total")


def q_training_curve(spark, sf_dir):
    m = model_of(spark, sf_dir)
    lines = mixing.split_pool(document_lines(spark, sf_dir))
    n = len(m.strings)
    out = evaluate.training_curve(lines.where("part = 'pool'"), lines.where("part = 'heldout'"), m, [n - MERGES_2 - MERGES_1, n - MERGES_2, n])
    return out.select("stage", (F.col("vocab_size") - n).cast("long").alias("vocab_offset"), "split", _named("ALL"), "tokens_per_char")


def _vocabularies(spark, sf_dir):
    """Symbols of 60 merges of normalised English lines, and of the others."""
    lines = profile.normalized_lines(document_lines(spark, sf_dir)).select("lang", F.col("processed").alias("text"))
    sides = []
    for langs in ("lang = 'en'", "lang <> 'en'"):
        s = Symbols()
        learn_units(counts.word_freq(lines.where(langs)), 60, s, more=True)
        sides.append(spark.createDataFrame([(x,) for x in s.strings if len(x) > 1], "str string"))
    return sides


def q_vocab_diff(spark, sf_dir):
    return evaluate.vocabulary_diff(*_vocabularies(spark, sf_dir), k=25, containing="[U+")


def q_vocab_diff_all(spark, sf_dir):
    return evaluate.vocabulary_diff(*_vocabularies(spark, sf_dir), k=25, containing="")


def q_tier2_report(spark, sf_dir):
    """Compression of other tables' texts by the vocabulary of the documents, with a description where there is one."""
    m = model_of(spark, sf_dir)
    texts = table(spark, sf_dir, "conversations").select(F.col("role").alias("lang"), F.col("conv_id").alias("doc_id"), "text")
    by = evaluate.compression(evaluate.token_stats(lines(texts), m)).where("NOT total")
    names = spark.createDataFrame([("user", "asks")], "lang string, mirror string")
    return by.join(F.broadcast(names), "lang", "left").select("lang", F.coalesce("mirror", F.lit("")).alias("mirror"), "tokens", "chars", "crossing_pct")


def q_sample_trim(spark, sf_dir):
    """The first 500 bytes of each document, trimmed to whole lines, and their size."""
    head = F.make_valid_utf8(F.substring(F.col("text").cast("binary"), 1, 500).cast("string"))
    t = trimmed_to_line(head)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), sample_size(t).getField("lines").alias("n_lines"))


def q_lines_nonblank(spark, sf_dir):
    return document_lines(spark, sf_dir, "nonblank").groupBy("lang").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


def q_sample_jobs(spark, sf_dir):
    return sample_jobs(spark)


def q_slugs(spark, sf_dir):
    """Files and names by language of both registries."""
    a = source_registry(mixing.registry(spark, zulu=True), "raw").select("name", "path", F.lit(None).cast("string").alias("slug"))
    b = mixing.coverage(spark).select(F.col("lang").alias("name"), F.lit(None).cast("string").alias("path"), coverage_slug(F.col("lang")).alias("slug"))
    return a.unionByName(b)


def q_coverage_manifest(spark, sf_dir):
    return mixing.coverage_manifest(spark)


def q_strict_filter(spark, sf_dir):
    """Lines with letters of another profile's script, which only the strict filter drops."""
    lines = document_lines(spark, sf_dir, "all").withColumn("text", F.translate("text", "éñç", "ሀሁሂ"))
    reason = lambda **k: scripts.contamination(F.col("text"), "latin", **k)
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), reason(strict=True).alias("strict"), reason().alias("usual")).where("strict IS NOT NULL OR usual IS NOT NULL")


def q_assembly_report(spark, sf_dir):
    return mixing.assembly_report(_pool(spark, sf_dir), _targets(spark, 1.0))


def q_spot_check(spark, sf_dir):
    out = evaluate.spot_check(document_lines(spark, sf_dir), model_of(spark, sf_dir))
    return out.select("lang", "doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("tokens").cast("long").alias("tokens"), "same")


def q_validation(spark, sf_dir):
    checks = evaluate.validate(model_of(spark, sf_dir), lines=document_lines(spark, sf_dir))
    return spark.createDataFrame(list(checks.items()), "name string, holds boolean")


def q_tokenised_sample(spark, sf_dir):
    """The first line of each language as two vocabularies tokenise it: the tokens' number, and the first of them."""
    m = model_of(spark, sf_dir)
    first = document_lines(spark, sf_dir).groupBy("lang").agg(F.min(F.struct("doc_id", "line_no", "text")).alias("f")).select("lang", "f.text").collect()  # a row a language
    rows = [(r.lang, name, n, some[0]) for r in first for name, (n, some) in evaluate.tokenised(r.text, {"all": m, "words": Model(m.strings, m.stage1, [])}, 1).items()]
    return spark.createDataFrame(rows, "lang string, config string, tokens long, first string")


def q_alignment(spark, sf_dir):
    """All lines by the shared vocabulary, which joins words, and by one that was learned inside words alone."""
    lines = document_lines(spark, sf_dir)
    return align.alignment(lines, model_of(spark, sf_dir), train_words(lines, MERGES_1 + 10, more=True), "lang")


def q_corpus_files(spark, sf_dir):
    """Lines written by language and read again from the files."""
    lines = document_lines(spark, sf_dir).select("lang", F.regexp_replace("text", r"\r", " ").alias("text"), "doc_id", "line_no")
    folder = scratch(spark, "corpus-")
    sinks.write_corpus(lines, folder)
    read = file_lines(spark, discarded(spark, folder) + "/*")
    return read.groupBy(F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang")).agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


def _saved(spark, sf_dir) -> Model:
    """The shared vocabulary through its document."""
    path = scratch(spark, "model-") + ".json"
    model_of(spark, sf_dir).save(path if "://" in path else f"file://{path}")
    return Model.load(discarded(spark, path if "://" in path else f"file://{path}"))


def q_model_vocabulary(spark, sf_dir):
    """The strings of the merges, from the saved document."""
    m = _saved(spark, sf_dir)
    vocab, _ = m.tables(spark)
    return vocab.where(F.col("id") >= len(m.strings) - len(m.merges)).select(F.col("id").cast("long").alias("id"), "str", F.col("n_spaces").cast("long").alias("n_spaces"))


def q_snapshot_merges(spark, sf_dir):
    """The merges of the model as it was 25 merges before its end."""
    m = _saved(spark, sf_dir)
    return _merge_rows(spark, m.at(len(m.strings) - 25).merges)


def q_resumed_merges(spark, sf_dir):
    """Learned up to 12 merges, and then from the checkpoint up to 30."""
    path = scratch(spark, "merges-")
    mark = Checkpoint(f"{path if '://' in path else 'file://' + path}/stage1.json", 5)
    units = counts.word_freq(document_lines(spark, sf_dir))
    for n in (12, 30):
        merges = learn_units(units, n, Symbols(), checkpoint=mark, more=True)
    discarded(spark, path)
    return _merge_rows(spark, merges)


def q_one_stage_tokens(spark, sf_dir):
    """The one-stage baseline, whose white space counts as characters only."""
    lines = document_lines(spark, sf_dir)
    stats = evaluate.word_stats(lines, train_words(lines, MERGES_1, more=True))
    return evaluate.compression(stats, "words").where("NOT total").select("lang", "tokens", "chars")


def q_sql_functions(spark, sf_dir):
    """The text functions by their names in SQL."""
    register(spark, model_of(spark, sf_dir))
    document_lines(spark, sf_dir).createOrReplaceTempView("some_lines")
    return spark.sql(
        "SELECT lang, sum(length(preprocess_text(text))) AS n_processed, sum(size(bpe_encode(text))) AS tokens, "
        "sum(CAST(bpe_decode(bpe_encode(text)) <> text AS BIGINT)) AS n_mismatch FROM some_lines GROUP BY lang"
    )


def q_bpe_tokens(spark, sf_dir):
    """Tokens as rows: the table function on each language's first line."""
    register(spark, model_of(spark, sf_dir))
    lines = document_lines(spark, sf_dir)
    first = lines.groupBy("lang").agg(F.min(F.struct("doc_id", "line_no", "text")).alias("f")).select("lang", "f.text")
    first.createOrReplaceTempView("first_lines")
    return spark.sql("SELECT lang, CAST(place AS BIGINT) AS place, CAST(id AS BIGINT) AS id FROM first_lines, LATERAL bpe_tokens(text)")


def q_token_counts(spark, sf_dir):
    """Tokens of all lines by language, by the table function over a table: languages are dealt in buckets of documents, whose counts are added up."""
    register(spark, model_of(spark, sf_dir))
    document_lines(spark, sf_dir).select("lang", F.pmod("doc_id", F.lit(32)).alias("bucket"), "text").createOrReplaceTempView("all_lines")
    return spark.sql("SELECT lang, id, sum(n) AS n FROM bpe_token_counts(TABLE(all_lines) PARTITION BY (lang, bucket), 'text') GROUP BY lang, id")


def q_line_examples(spark, sf_dir):
    dropped = scripts.filter_lines(injected(spark, sf_dir))[1]
    return scripts.examples(dropped, 2).select("lang", "doc_id", F.col("line_no").cast("long").alias("line_no"), "reason", "example")


def q_tpch_rollup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    d = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return li.rollup("l_returnflag", "l_linestatus").agg(d("l_quantity").alias("sum_qty"), d("l_extendedprice").alias("sum_price"), F.count("*").alias("n"))


def q_events_tumbling(spark, sf_dir):
    e = event_counts(table(spark, sf_dir, "events"))
    return e.groupBy("event_type").agg(F.count("*").alias("n_windows"), F.max("n").alias("most"), F.sum("n").alias("n"))


QUERIES = {k: v for k, v in sorted(globals().items()) if k.startswith("q_")}
