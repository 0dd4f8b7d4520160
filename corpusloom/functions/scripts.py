"""Foreign-script predicate: one character class for each script, counted in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Tally

#: Name prefixes of scripts that no target language is written in.
FOREIGN = (
    "ARABIC",
    "BENGALI",
    "DEVANAGARI",
    "CYRILLIC",
    "GREEK",
    "HEBREW",
    "CJK",
    "HIRAGANA",
    "KATAKANA",
    "HANGUL",
    "THAI",
    "TAMIL",
    "TELUGU",
    "KANNADA",
    "GUJARATI",
    "GURMUKHI",
    "ORIYA",
    "MALAYALAM",
    "SINHALA",
    "MYANMAR",
    "KHMER",
    "LAO",
    "TIBETAN",
    "GEORGIAN",
    "ARMENIAN",
)
#: Prefixes that are allowed in any script, and profiles of target scripts.
ALWAYS = ("COMBINING", "MODIFIER LETTER")
PROFILES = {"latin": ("LATIN",), "ethiopic": ("ETHIOPIC", "LATIN")}


@lru_cache
def ranges(prefix: str, allowed: tuple[str, ...] = ()) -> tuple[tuple[int, int], ...]:
    """Code points beyond ASCII whose names begin with a prefix and with none that is allowed, as ranges."""
    out: list[list[int]] = []
    skip = ALWAYS + allowed
    for cp in range(128, sys.maxunicode + 1):
        name = unicodedata.name(chr(cp), "")
        if name.startswith(prefix) and not name.startswith(skip):
            if out and out[-1][1] == cp - 1:
                out[-1][1] = cp
            else:
                out.append([cp, cp])
    return tuple((a, b) for a, b in out)


def char_class(prefix: str, allowed: tuple[str, ...] = (), dialect: str = "java") -> str:
    one = {"java": lambda c: f"\\x{{{c:X}}}", "re2": lambda c: f"\\x{{{c:X}}}"}[dialect]
    return "[" + "".join(one(a) if a == b else f"{one(a)}-{one(b)}" for a, b in ranges(prefix, allowed)) + "]"


def contamination(text: Column, profile: str = "latin", least: int = 3, strict: bool = False) -> Column:
    """The first script, in the order in which scripts are met in the text, with ``least`` characters or more; null if there is none.

    A profile's own scripts are never counted; none of the fixed profiles is among the foreign ones, so it changes
    nothing by itself. With strict, scripts of the other profiles count as foreign too.
    """
    allowed = PROFILES[profile]
    scripts = FOREIGN + (tuple(sorted({p for v in PROFILES.values() for p in v} - set(allowed))) if strict else ())
    classes = {s: char_class(s, allowed) for s in scripts if ranges(s, allowed)}
    lowest = min(ranges(s, allowed)[0][0] for s in classes)
    # all that lies below every foreign script goes first, by one range; what is left is short, and mostly nothing
    rest = F.regexp_replace(text, f"[\\x{{0}}-\\x{{{lowest - 1:X}}}]+", "")

    def first(r: Column) -> Column:
        found = [F.when(F.regexp_count(r, F.lit(c)) >= least, F.struct(F.regexp_instr(r, F.lit(c)).alias("at"), F.lit(s).alias("script"))) for s, c in classes.items()]
        return F.when(F.length(r) >= least, F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))["script"])

    once = F.get(F.transform(F.array(rest), first), F.lit(0))  # the lambda's argument is computed once
    return F.when(text.rlike(f"[^\\x{{0}}-\\x{{{lowest - 1:X}}}]"), once)


def filter_lines(lines: DataFrame, profile: str = "latin", least: int = 3, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) lines; dropped ones have a column ``reason``."""
    judged = lines.withColumn("reason", contamination(F.col("text"), profile, least, strict))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def filter_stats(lines: DataFrame, profile: str = "latin", least: int = 3, terminated: bool = True) -> DataFrame:
    """total and dropped lines and characters by language, with their percentages; a terminated line has its line end as a character."""
    judged = lines.withColumn("reason", contamination(F.col("text"), profile, least))
    size = F.length("text") + int(terminated)
    gone = F.col("reason").isNotNull()
    out = judged.groupBy("lang").agg(
        F.count("*").alias("total_lines"),
        F.sum(F.when(gone, 1).otherwise(0)).cast("long").alias("dropped_lines"),
        F.sum(size).cast("long").alias("total_chars"),
        F.sum(F.when(gone, size).otherwise(0)).cast("long").alias("dropped_chars"),
    )
    for what in ("lines", "chars"):
        out = out.withColumn(f"pct_{what}", 100.0 * F.col(f"dropped_{what}") / F.greatest(F.col(f"total_{what}"), F.lit(1)))
    return out


def judged_once(lines: DataFrame, profile: str = "latin", least: int = 3, strict: bool = False) -> tuple[DataFrame, Tally]:
    """All lines with their reason (null: kept), and a tally of lines and characters (each line with its end), of what is dropped, and of the dropped lines of each script.

    The tally is filled by whatever first takes the lines to its end, while they pass by: so writing them is one scan that judges each line once.
    """
    reason = F.col("reason")
    size = F.coalesce(F.length("text") + 1, F.lit(0))
    names = [*FOREIGN, *sorted({p for v in PROFILES.values() for p in v})]
    tally = Tally(
        total_lines=F.count(F.lit(1)),
        dropped_lines=F.count(reason),
        total_chars=F.coalesce(F.sum(size), F.lit(0)),
        dropped_chars=F.coalesce(F.sum(F.when(reason.isNotNull(), size)), F.lit(0)),
        **{n: F.count_if(F.coalesce(reason == n, F.lit(False))) for n in names},
    )
    return tally.watched(lines.withColumn("reason", contamination(F.col("text"), profile, least, strict))), tally


def tally_stats(tally: Tally) -> dict[str, float]:
    """The figures of filter_stats() over all languages, from a tally that is filled."""
    t = {k: v for k, v in tally.get().items() if k.islower()}
    return t | {f"pct_{w}": 100.0 * t[f"dropped_{w}"] / max(t[f"total_{w}"], 1) for w in ("lines", "chars")}


def tally_reasons(tally: Tally) -> list[tuple[str, int]]:
    """The rows of drop_reasons(), from a tally that is filled."""
    return sorted(((k, v) for k, v in tally.get().items() if not k.islower() and v), key=lambda x: (-x[1], x[0]))


def drop_reasons(lines: DataFrame, profile: str = "latin", least: int = 3) -> DataFrame:
    """(reason, n) most frequent first."""
    return filter_lines(lines, profile, least)[1].groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def examples(dropped: DataFrame, k: int = 2, width: int = 160) -> DataFrame:
    """The first k dropped lines of each language, cut to a width."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("lang").orderBy("doc_id", "line_no")
    return dropped.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("lang", "doc_id", "line_no", "reason", F.left(F.trim("text"), F.lit(width)).alias("example"))
