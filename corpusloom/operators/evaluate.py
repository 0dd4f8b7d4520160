"""Reports on encoded text: compression, crossing tokens, configurations, vocabularies, curves, round trips."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..session import ship
from .bpe.chain import apply_ranks
from .bpe.codec import FEW_MERGES, BatchCodec, Codec, Words, decode, encode, parts_of, sharing
from .bpe.model import Model


def crossing_ids(model: Model, strict: bool = False) -> list[int]:
    """Symbols that hold a space; with strict only those that hold something else as well."""
    return [i for i, s in enumerate(model.strings) if " " in s and (not strict or s.strip(" "))]


def token_stats(lines: DataFrame, model: Model) -> DataFrame:
    """(lang, tokens, chars, crossing) by line; crossing counts tokens that hold a space. Ids stay in the workers: only their numbers leave."""
    return _stats(lines, {"": (model, [])}).select("lang", "tokens", "chars", "crossing")


def word_stats(lines: DataFrame, model: Model) -> DataFrame:
    """(lang, tokens, chars, crossing) by line for a model that only joins within words: what stands for white space are characters, and no tokens."""
    return token_stats(lines, model).withColumn("tokens", F.col("tokens") - F.col("crossing")).withColumn("crossing", F.lit(0).cast("long"))


def _stats(lines: DataFrame, models: dict[str, tuple[Model, list[int]]], by: tuple[str, ...] = ("lang",)) -> DataFrame:
    """(config, size, columns ``by``, tokens, chars, crossing) by line, for models and the sizes of their snapshots (none: as they are): one scan, and one pass of merges for all snapshots of a model."""
    spark = ship(lines.sparkSession)
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = FEW_MERGES if len(shared.value) == 1 else 0  # else words are split once for all
        codecs = {k: (BatchCodec(m, few), sizes) for k, (m, sizes) in shared.value.items()}
        sharing([c for c, _ in codecs.values()])
        flags = {k: np.array([" " in s for s in m.strings]) for k, (m, _) in shared.value.items()}
        for b in parts_of(batches, "text"):
            text = b.column("text")
            chars = pc.utf8_length(text).cast(pa.int64())
            split = Words.split(text) if any(c.words is not None and not sizes for c, sizes in codecs.values()) else None
            for k, (codec, sizes) in codecs.items():
                m = codec.model

                def cols(size: int, tokens: np.ndarray, crossing: np.ndarray) -> pa.RecordBatch:
                    n = b.num_rows
                    cols = [pa.array([k] * n, pa.string()), pa.array(np.full(n, size)), *map(b.column, by), pa.array(tokens), chars, pa.array(crossing)]
                    return pa.RecordBatch.from_arrays(cols, names=["config", "size", *by, "tokens", "chars", "crossing"])

                if not sizes and (both := codec.counts(text, split)):  # a token that holds a space is one
                    yield cols(len(m.strings), *both)
                    continue
                chain = codec.chain(text) if sizes else codec.coded(text, split)
                stops = [sum(x[2] < v for x in m.merges) for v in sizes]

                def row(size: int, tokens: np.ndarray) -> pa.RecordBatch:
                    hit = np.append(flags[k], False)[np.minimum(chain.sym.view(np.uint32), np.uint32(len(m.strings)))]  # neither ends nor escaped characters hold one
                    x = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
                    return cols(size, tokens, x[chain.ends[1:]] - x[chain.ends[:-1]])

                if not sizes:
                    yield row(len(m.strings), chain.counts())
                    continue
                order = np.argsort(stops, kind="stable").tolist()
                steps = apply_ranks(chain, codec.ranks, sorted(stops))
                for i in order:
                    yield row(sizes[i], next(steps))

    kept = lines.select(*by, "text").where("text IS NOT NULL")
    counts = [StructField(c, LongType()) for c in ("tokens", "chars", "crossing")]
    return kept.mapInArrow(run, StructType([StructField("config", StringType()), StructField("size", LongType()), *kept.select(*by).schema.fields, *counts]))


def compression(stats: DataFrame, mode: str = "line", *by: str) -> DataFrame:
    """tokens, chars, ratio and crossing % by language, and over all, within the columns ``by`` if there are any.

    The row over all has ``total`` true and a null lang; lines without a language are a language of their own, with total false.

    mode "blob" takes a language as one text, in which each line end is a token and a character; "words" counts these
    characters but no tokens for them, as where white space is dropped before encoding.
    """
    more = {"line": (0, 0), "blob": (1, 1), "words": (0, 1)}[mode]
    one = stats.groupBy(*by, "lang").agg(F.sum("tokens").alias("t"), F.sum("chars").alias("c"), F.sum("crossing").alias("x"), F.count("*").alias("n"))
    one = one.select(*by, "lang", (F.col("t") + more[0] * (F.col("n") - 1)).alias("t"), (F.col("c") + more[1] * (F.col("n") - 1)).alias("c"), "x")
    out = one.groupingSets([[*by, "lang"], list(by)], *by, "lang").agg((F.grouping("lang") == 1).alias("total"), F.sum("t").alias("tokens"), F.sum("c").alias("chars"), F.sum("x").alias("crossing"))
    return out.select(*by, "lang", "total", "tokens", "chars", "crossing", ratio(F.col("tokens"), F.col("chars")).alias("tokens_per_char"), (100.0 * F.col("crossing") / F.greatest("tokens", F.lit(1))).alias("crossing_pct"))


def ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def worst_language(by_lang: DataFrame, order: str = "lang") -> DataFrame:
    """The language with the highest ratio; of equals the first in an order, a null one before others."""
    return by_lang.where("NOT total").agg(F.min_by("lang", F.struct(-F.col("tokens_per_char"), F.col(order))).alias("lang"), F.max("tokens_per_char").alias("tokens_per_char"))


def against_baseline(results: DataFrame, baseline: str, flag_over: float = 5.0) -> DataFrame:
    """Adds to (config, lang, total, value) the change against a configuration in % and a flag for what is worse by more than flag_over."""
    base = F.max(F.when(F.col("config") == baseline, F.col("value"))).over(Window.partitionBy("lang", "total"))
    out = results.withColumn("base", base)
    pct = F.when((F.col("config") != baseline) & (F.col("base") > 0), 100.0 * (F.col("value") - F.col("base")) / F.nullif("base", F.lit(0.0))).otherwise(0.0)
    return out.withColumn("pct", pct).withColumn("flag", F.when(F.col("pct") > flag_over, "!!").otherwise("")).drop("base")


def sweep(lines: DataFrame, models: dict[str, Model], baseline: str, mode: str = "blob") -> DataFrame:
    """All configurations on the same lines by one scan, in long form, with their change against the baseline; over all, total is true and lang BLENDED."""
    stats = _stats(lines, {k: (m, []) for k, m in models.items()})
    by = compression(stats, mode, "config")
    return against_baseline(by.select("config", F.when(F.col("total"), "BLENDED").otherwise(F.col("lang")).alias("lang"), "total", F.col("tokens_per_char").alias("value")), baseline)


def sweep_document(results: DataFrame) -> dict:
    """What sweep() gives as a document: {"results": {config: {lang: value}}, "blended": {config: value}}; a null language is null."""
    out: dict = {"results": {}, "blended": {}}
    for r in results.orderBy("config", "lang").collect():
        if r.total:
            out["blended"][r.config] = r.value
        else:
            out["results"].setdefault(r.config, {})[r.lang] = r.value
    return out


def available(wanted: list[str], lines: DataFrame) -> list[str]:
    """Those of the languages wanted that there are lines of, in their order."""
    there = {r[0] for r in lines.where(F.col("lang").isin(wanted)).select("lang").distinct().collect()}
    return [x for x in wanted if x in there]


def tokenised(text: str, models: dict[str, Model], k: int = 40) -> dict[str, tuple[int, list[str]]]:
    """A sample as each model tokenises it: number of tokens, and the first k as strings."""
    out = {}
    for name, m in models.items():
        c = Codec(m)
        ids = c.encode(text)
        out[name] = (len(ids), [c.string(i) for i in ids[:k]])
    return out


def vocabulary_diff(old: DataFrame, new: DataFrame, k: int = 25, containing: str = "[U+") -> DataFrame:
    """Symbols (str) of one vocabulary that the other lacks, and contain a text: the k longest on either side as (side, str)."""

    def side(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        only = a.select("str").distinct().join(b.select("str").distinct(), "str", "left_anti").where(F.contains("str", F.lit(containing)))
        return only.orderBy(F.desc(F.length("str")), "str").limit(k).select(F.lit(name).alias("side"), "str")

    return side(old, new, "lost").unionByName(side(new, old, "gained"))


def round_trip(lines: DataFrame, model: Model) -> DataFrame:
    """Lines and characters checked, mismatches and the first of them; the encoder works in the workers, the decoder is a column."""
    back = decode(encode(lines, model), model)
    bad = ~F.col("text").eqNullSafe(F.col("decoded"))
    return back.agg(
        F.count("*").alias("n_lines"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"),
        F.sum(bad.cast("long")).alias("n_mismatch"),
        F.min(F.when(bad, F.struct("doc_id", "line_no"))).alias("first_mismatch"),
    )


#: Texts that an encoder easily gets wrong.
ADVERSARIAL = (
    "",
    "a",
    " ",
    "   ",
    "!@#$%^&*()_+-=[]{}|;:',.<>/?`~",
    "a" * 500,
    "word " * 200,
    '"quoted text with \'nested\' quotes"',
    "line\twith\ttabs\tif\tany\tsurvive\tpreprocessing",
)


def validate(model: Model, most: int = 20_000, lines: DataFrame | None = None) -> dict[str, bool]:
    """Hard limits: size, types and the adversarial texts, with two codecs; with lines also their round trip. ``passed`` is whether all hold."""
    one, two = Codec(model), Codec(model)
    ids = [one.encode(t) for t in ADVERSARIAL]
    checks = {
        "vocab_size": len(model.strings) <= most,
        "types": all(isinstance(i, int) for x in ids for i in x),
        "edge_cases": all(two.decode(x) == t for x, t in zip(ids, ADVERSARIAL, strict=True)),
    }
    if lines is not None:
        checks["losslessness"] = round_trip(lines, model).first().n_mismatch == 0
    return checks | {"passed": all(checks.values())}


def spot_check(lines: DataFrame, model: Model, k: int = 20) -> DataFrame:
    """The first k lines of each language, by doc_id and line_no, as they come back."""
    order = Window.partitionBy("lang").orderBy("doc_id", "line_no")
    some = lines.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    back = decode(encode(some, model), model)
    return back.select("lang", "doc_id", "line_no", F.size("ids").alias("tokens"), F.col("text").eqNullSafe(F.col("decoded")).alias("same"))


def training_curve(train: DataFrame, heldout: DataFrame, model: Model, sizes: list[int]) -> DataFrame:
    """(stage, vocab_size, split, lang, total, tokens_per_char) of the model's snapshots; total marks the rows over all.

    Lines are encoded once: a larger snapshot goes on where the smaller one ends.
    """
    lines = train.select(F.lit("train").alias("split"), "lang", "text").unionByName(heldout.select(F.lit("heldout").alias("split"), "lang", "text"))
    stats = _stats(lines, {"": (model, sizes)}, ("split", "lang"))
    by = compression(stats, "line", "size", "split")
    stage = F.when(F.col("size") <= len(model.strings) - len(model.stage2), 1).otherwise(2)
    return by.select(stage.alias("stage"), F.col("size").cast("int").alias("vocab_size"), "split", "lang", "total", "tokens_per_char")


def curve_document(curve: DataFrame) -> list[dict]:
    """What training_curve() gives as a list of points, as documents hold it; a null language is null."""
    out: dict[tuple, dict] = {}
    for r in curve.collect():
        p = out.setdefault((r.stage, r.vocab_size), {"stage": r.stage, "vocab_size": r.vocab_size, "train_tokens_per_char": None, "heldout_tokens_per_char": None, "train_per_lang": {}, "heldout_per_lang": {}})
        if r.total:
            p[f"{r.split}_tokens_per_char"] = r.tokens_per_char
        else:
            p[f"{r.split}_per_lang"][r.lang] = r.tokens_per_char
    return [out[k] for k in sorted(out)]


def throughput(spark: SparkSession, lines: DataFrame, model: Model, budget_s: float = 1200.0, chars: int = 2_000_000) -> dict[str, object]:
    """Characters a second of an encoding run, the time for ``chars``, and whether that is within half of the budget, all of it, or neither."""
    began = time.perf_counter()
    n = token_stats(lines, model).agg(F.sum("chars"), F.sum("tokens")).first()
    took = time.perf_counter() - began
    rate = (n[0] or 0) / max(took, 1e-9)
    need = chars / max(rate, 1e-9)
    return {"chars_per_s": rate, "projected_s": need, "status": "OK" if need < 0.5 * budget_s else "TIGHT" if need < budget_s else "FAIL"}
