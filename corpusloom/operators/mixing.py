"""Temperature mixing of languages, and the deterministic split, slice and tile of their text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalize import marker, normalize_text

#: Language, bytes of its download, bytes a character, expansion by normalisation, whether that is all the clean text there is.
LANGUAGES = (
    ("Amharic", 1_056_155_518, 2.5852, 23.23, False),
    ("Hausa", 668_249_719, 1.0125, 1.04, False),
    ("Somali", 1_348_375_947, 1.0051, 1.01, False),
    ("Swahili", 2_705_897_507, 1.0057, 1.00, False),
    ("Yoruba", 170_940_054, 1.2699, 4.80, False),
    ("Igbo", 177_620_308, 1.1902, 5.00, False),
    ("Kinyarwanda", 158_405_159, 1.0226, 1.01, False),
    ("Xhosa", 110_831_937, 1.0037, 1.02, False),
    ("Nigerian Pidgin", 50_200_890, 1.0000, 1.00, False),
    ("Luo", 870_230, 1.0000, 1.00, True),
    ("Kanuri", 1_037_543, 1.0000, 2.54, True),
    ("Dinka", 1_125_244, 1.0000, 6.92, True),
    ("Nama", 907_048, 1.0000, 6.89, True),
)
#: Fixed value: the row that the wider registry has behind Xhosa.
ZULU = ("Zulu", 263_444_670, 1.0039, 1.02, False)
REGISTRY = "name string, natural_raw_bytes long, bytes_per_char double, expansion_factor double, is_capped boolean"


def registry(spark: SparkSession, zulu: bool = False) -> DataFrame:
    rows = list(LANGUAGES)
    if zulu:
        rows.insert(8, ZULU)
    return spark.createDataFrame(rows, REGISTRY)


def shares(languages: DataFrame, alpha: float = 0.3, total_processed: float = 3e8) -> DataFrame:
    """Natural sizes, share of the mix (volume to the power alpha, over the sum), targets in characters, and how often text must repeat.

    repeat_factor is the target against the whole download, infinite without one; note says what a factor over 1 means.
    """
    out = languages.withColumn("natural_raw_chars", F.col("natural_raw_bytes") / F.col("bytes_per_char"))
    out = out.withColumn("natural_processed_chars", F.col("natural_raw_chars") * F.col("expansion_factor"))
    out = out.withColumn("weight", F.pow("natural_processed_chars", F.lit(alpha)))
    whole = out.agg(F.sum("weight").alias("all"))
    out = out.crossJoin(F.broadcast(whole)).withColumn("share", F.col("weight") / F.col("all")).drop("all")  # one row
    out = out.withColumn("target_processed", total_processed * F.col("share"))
    out = out.withColumn("target_raw", F.col("target_processed") / F.col("expansion_factor"))
    factor = F.when(F.col("natural_raw_chars") > 0, F.col("target_raw") / F.nullif("natural_raw_chars", F.lit(0.0))).otherwise(F.lit(float("inf")))
    note = F.when(F.col("repeat_factor") > 1, F.when(F.col("is_capped"), "MUST repeat").otherwise("would need more than downloaded")).otherwise("")
    return out.withColumn("target_raw_chars", F.col("target_raw").cast("long")).withColumn("repeat_factor", factor).withColumn("note", note)


def with_language(rows: DataFrame, others: DataFrame, how: str = "inner") -> DataFrame:
    """rows with what a broadcast frame of one row a language says of theirs; a null language is a language like any other."""
    named = others.withColumnRenamed("lang", "its_lang")
    return rows.join(F.broadcast(named), rows["lang"].eqNullSafe(named["its_lang"]), how).drop("its_lang")


def offsets(lines: DataFrame, ranges: int | None = None) -> DataFrame:
    """Adds start, the characters of a language before each line (each line with its end), in the order of doc_id (a number) and line_no, of equal ones by text.

    Each language's ids are cut into ``ranges`` ranges of about as many lines (the number of shuffle partitions, unless given), so that no
    language is one task: sums of the ranges are accumulated, which are few, and lines within a range.
    """
    n = ranges or max(2, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = F.length("text") + 1
    at = F.percentile_approx("doc_id", F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(100 * n))
    cuts = lines.groupBy("lang").agg(F.array_distinct(at).alias("cuts"))
    dealt = with_language(lines, cuts)
    dealt = dealt.withColumn("range", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("doc_id"))), F.lit(0))).drop("cuts")
    sums = dealt.groupBy("lang", "range").agg(F.sum(size).alias("chars"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("lang").alias("l"), F.col("range").alias("r"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("lang", "range").orderBy("doc_id", "line_no", "text").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("line_start", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    out = out.join(F.broadcast(sums), out["lang"].eqNullSafe(sums["l"]) & (out["range"] == sums["r"]))  # ranges times languages rows
    return out.withColumn("start", F.col("range_start") + F.col("line_start")).drop("range", "line_start", "range_start", "l", "r")


def split_pool(lines: DataFrame, heldout: float = 0.15) -> DataFrame:
    """Adds ``part``: "pool" for lines that start at or before the point 1 - heldout of their language's text, "heldout" behind it.

    So the line that the point falls in belongs to the pool, as where a text is cut at the next line end. Lines without a language are split as one.
    """
    at = offsets(lines)
    total = lines.groupBy("lang").agg((F.sum(F.length("text") + 1) - 1).alias("all"))
    point = F.floor(F.col("all") * (1 - heldout))
    return with_language(at, total).withColumn("part", F.when(F.col("start") <= point, "pool").otherwise("heldout")).drop("all")


def slice_or_tile(pool: DataFrame, targets: DataFrame, seam: str = "fuse") -> DataFrame:
    """The first target characters of each language's pool, which is repeated where it is shorter: (lang, copy, doc_id, line_no, text).

    targets has (lang, target); languages without one are left out, and a null language is named by null. Pool texts are joined by line ends and the last line is cut where the target falls.
    seam: "fuse" puts copies behind each other without a line end, so that the last line of one and the first of the next
    are one line (as two rows, of which the first has ``fused`` true); "newline" puts a line end between them.
    """
    at = offsets(pool)
    size = at.groupBy("lang").agg((F.sum(F.length("text") + 1) - 1 + int(seam == "newline")).alias("size"), F.max("start").alias("last"))
    plan = with_language(size, targets.select("lang", "target")).where("size > 0 AND target > 0").withColumn("copies", F.floor((F.col("target") - 1) / F.col("size")) + 1)
    copies = plan.select("lang", "size", "last", "target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    out = with_language(at, copies).withColumn("from", F.col("copy") * F.col("size") + F.col("start"))
    out = out.where(F.col("from") < F.col("target"))
    cut = F.substring("text", F.lit(1), (F.col("target") - F.col("from")).cast("int"))
    fused = (F.col("start") == F.col("last")) & F.lit(seam == "fuse") & (F.col("from") + F.length("text") < F.col("target"))
    return out.select("lang", "copy", "doc_id", "line_no", cut.alias("text"), fused.alias("fused"))


def assemble(lines: DataFrame, targets: DataFrame, heldout: float = 0.15) -> DataFrame:
    """The training corpus by line: split, slice or tile to target, and normalise; lines that hold nothing then are dropped."""
    from .profile import normalized_lines

    pool = split_pool(lines, heldout).where("part = 'pool'").drop("part", "start")
    out = normalized_lines(slice_or_tile(pool, targets, "newline"))
    return out.where("processed <> ''").select("lang", "copy", "doc_id", "line_no", F.col("processed").alias("text"))


def assembly_report(lines: DataFrame, targets: DataFrame, heldout: float = 0.15) -> DataFrame:
    """(lang, target, pool_chars, upsampled): whether the pool is shorter than the target; a target without lines has none."""
    pool = split_pool(lines, heldout).where("part = 'pool'").groupBy("lang").agg((F.sum(F.length("text") + 1) - 1).alias("pool_chars"))
    return with_language(targets, pool, "left").withColumn("pool_chars", F.coalesce("pool_chars", F.lit(0))).withColumn("upsampled", F.col("target") > F.col("pool_chars"))


def ethiopic_block() -> list[str]:
    """Named characters of the core Ethiopic block."""
    return [chr(c) for c in range(0x1200, 0x1380) if unicodedata.name(chr(c), "")]


#: Letters beyond ASCII that the orthographies need.
_YORUBA_TONES = ["̀", "́"]
COVERAGE = (
    ("Amharic", "Afroasiatic - Semitic", "CERTAIN (full Ethiopic Unicode block)", None),
    ("Hausa", "Afroasiatic - Chadic", "CERTAIN (standard Boko orthography hooked letters)", ["ɓ", "Ɓ", "ɗ", "Ɗ", "ƙ", "Ƙ", "ƴ", "Ƴ"]),
    ("Somali", "Afroasiatic - Cushitic", "CERTAIN (standard orthography is plain ASCII Latin)", []),
    ("Swahili", "Niger-Congo - Bantu", "CERTAIN (standard orthography is plain ASCII Latin)", []),
    ("Yoruba", "Niger-Congo - Volta-Niger", "LIKELY (standard orthography; verify tone-mark stacking against real corpus)", ["ẹ", "Ẹ", "ọ", "Ọ", "ṣ", "Ṣ", *_YORUBA_TONES, *"àáèéìíòóùúÀÁÈÉÌÍÒÓÙÚ", "ń", "ǹ"]),
    ("Igbo", "Niger-Congo - Volta-Niger", "LIKELY (standard orthography; verify tone-mark usage against real corpus)", ["ị", "Ị", "ụ", "Ụ", "ṅ", "Ṅ", *_YORUBA_TONES]),
    ("Kinyarwanda", "Niger-Congo - Bantu", "LIKELY (standard orthography is plain ASCII Latin)", []),
    ("Nigerian Pidgin", "English Creole", "CERTAIN (English-lexified, plain ASCII)", []),
    ("Luo (Dholuo)", "Nilo-Saharan - Nilotic", "VERIFY (no confirmed diacritic set -- run analyzer on real corpus)", []),
    ("Kanuri", "Nilo-Saharan - Saharan", "VERIFY (eng letter likely; confirm against real corpus)", ["ŋ", "Ŋ"]),
    ("Dinka", "Nilo-Saharan - Nilotic", "VERIFY (known complex diacritic system -- length/breathy voice/tone; run analyzer on real corpus before trusting any hand list)", []),
    ("Nama (Khoekhoegowab)", "Khoisan - Khoe-Kwadi", "LIKELY (4 core click letters certain; tone/nasalization marks need corpus verification)", ["ǀ", "ǁ", "ǂ", "ǃ", "́", "̀", "̃"]),
)


def coverage(spark: SparkSession) -> DataFrame:
    """(lang, family, confidence, codepoints)."""
    rows = [(a, b, c, ethiopic_block() if d is None else d) for a, b, c, d in COVERAGE]
    return spark.createDataFrame(rows, "lang string, family string, confidence string, codepoints array<string>")


def coverage_supplement(registry: DataFrame, repeats: int = 40) -> DataFrame:
    """Adds num_codepoints and ``supplement``: each code point in short word-like contexts, repeated, joined by spaces."""
    word = lambda c: F.concat(F.lit("a"), c, F.lit("b "), c, F.lit("a "), c, c)
    text = F.array_join(F.flatten(F.transform("codepoints", lambda c: F.array_repeat(word(c), repeats))), " ")
    return registry.withColumn("num_codepoints", F.size("codepoints").cast("long")).withColumn("supplement", text)


def coverage_manifest(spark: SparkSession) -> DataFrame:
    """(lang, char, char_escaped, marker) of all code points: what normalisation makes of each."""
    rows = [(lang, c, c.encode("unicode_escape").decode(), normalize_text(c) or marker(c)) for lang, _, _, cps in COVERAGE for c in (ethiopic_block() if cps is None else cps)]
    return spark.createDataFrame(rows, "lang string, char string, char_escaped string, marker string")
