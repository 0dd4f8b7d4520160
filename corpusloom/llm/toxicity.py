"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, with exception phrases, normalised by length."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import table

#: Words that are insults by themselves, in English and in the other languages of the corpus; what labels teach comes on top.
TERMS = (
    "idiot idiots moron morons stupid loser losers scum worthless pathetic disgusting trash clown dumbass asshole bastard bitch "
    "retard retarded imbecile cretin jerk crap fuck fucking shit bullshit whore slut pig filthy vermin subhuman degenerate "
    "dummkopf arschloch wichser scheisse abschaum connard salope encule ordure imbecil estupido pendejo cabron mierda gilipollas"
).split()
#: What makes a term harmless where it stands.
EXCEPTIONS = (
    "clown fish", "clown car", "class clown", "trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "take out the trash",
    "sore loser", "guinea pig", "guinea pigs", "pig iron", "piggy bank", "idiot proof", "idiot s guide", "the idiot by dostoevsky", "pathetic fallacy",
    "knee jerk", "jerk chicken", "not stupid", "not worthless", "stupid question", "fire retard",
)

#: Look-alikes of other scripts (Cyrillic, Greek) for the Latin letter in the same place below.
LIKE = ("абсԁеһіјкӏмոорԛгѕтυѵԝхуαβεηικνορτυωχγ", "abcdehijklmnopqrstuvwxyabenikvoptuwxy")
#: Digits and signs for letters. i, l and what stands for either are one letter.
SIGNS = {"0": "o", "1": "i", "!": "i", "|": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "8": "b", "9": "g", "l": "i", "L": "i"}


def _fold_table() -> dict[int, str]:
    """Each character to one character, so that offsets stay: case, accents, full width, look-alikes, signs; all else that is no letter to a space."""
    import unicodedata

    out: dict[int, str] = {}
    for c in map(chr, [*range(0x250), *range(0x370, 0x590), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)]):
        base = unicodedata.normalize("NFKD", c)[0].lower() if len(c) == 1 else c
        out[ord(c)] = base if len(base) == 1 else c
    for a, b in zip(*LIKE, strict=True):
        out[ord(a)] = out[ord(a.upper()) if len(a.upper()) == 1 else ord(a)] = b
    for c in [*range(128), 0x85, 0xA0, *range(0x2000, 0x200B), *range(0x2010, 0x2070), 0x3000]:
        if not chr(c).isalnum():
            out[c] = " " if chr(c).isspace() or chr(c) in JOINERS else "."
    out |= {ord(k): v for k, v in SIGNS.items()}
    out[ord("ß")] = "s"
    for c in range(0xFF01, 0xFF5F):
        out[c] = out.get(c - 0xFEE0, " ")
    return out


#: What may stand between the words of an exception phrase, besides white space.
JOINERS = "-'\u2018\u2019\u2010\u2011"
FOLD = _fold_table()
#: Characters that are not seen, or only as marks on others: combining marks, and zero-width and soft-hyphen signs. They go before folding.
UNSEEN = {c: None for c in [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, *range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x2100), *range(0xFE00, 0xFE10), *range(0xFE20, 0xFE30)]}
_UNSEEN = re.compile("[" + "".join(map(chr, UNSEEN)) + "]")


def seen(text: str) -> str:
    return text if text.isascii() else _UNSEEN.sub("", text)


def fold(text: str) -> str:
    """Each character of a text without UNSEEN as one: letters as plain lower-case ones, white space and JOINERS as a space, other signs as a full stop."""
    return text.translate(FOLD)


def _same(term: str) -> str:
    return " ".join(fold(seen(term)).split())


@dataclass
class Lexicon:
    """The automaton of the terms, and the pattern of the exception phrases, which is run over texts with a hit alone."""

    terms: ahocorasick.Automaton
    excused: re.Pattern | None


def automaton(weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    a = ahocorasick.Automaton()
    for term, w in weights.items():
        a.add_word(word := _same(term.rstrip("*")), (len(word), term, w))
    a.make_automaton()
    phrases = sorted({_same(p) for p in exceptions}, key=lambda p: (-len(p), p))
    alone = "|".join(" +".join(map(re.escape, p.split())) for p in phrases)
    return Lexicon(a, re.compile(f"(?=({alone}))") if phrases else None)


def _stands_alone(text: str, s: int, e: int, stem: bool = False) -> bool:
    return not (s and text[s - 1].isalnum()) and not (e < len(text) and text[e].isalnum() and not stem)


def hits(text: str, lexicon: Lexicon) -> list[tuple[int, int, str, float]]:
    """(start, end, term, weight) of the terms that stand as words of their own, or begin one if they end in *, and in no exception phrase; of overlapping ones all, by end. Offsets are those of the text as it is."""
    shown = seen(text)
    folded = fold(shown)
    found = []
    for end, (n, term, w) in lexicon.terms.iter(folded):
        s, e = end - n + 1, end + 1
        if _stands_alone(shown, s, e, term[-1] == "*"):
            found.append((s, e, term, w))
    if not found:
        return found
    if lexicon.excused:
        spans = [m.span(1) for m in lexicon.excused.finditer(folded) if _stands_alone(shown, *m.span(1))]
        ends, starts = list(accumulate((e for _, e in spans), max)), [s for s, _ in spans]
        found = [h for h in found if not (k := bisect_right(starts, h[0])) or ends[k - 1] < h[1]]
    if len(shown) < len(text):
        at = [i for i, c in enumerate(text) if ord(c) not in UNSEEN]
        found = [(at[s], at[e - 1] + 1, term, w) for s, e, term, w in found]
    return found


def measures(text: str | None, a: Lexicon, least: dict[str, int]) -> tuple[float, float, float]:
    """What the score is made of: the weight of all hits, the same for a hundred words of length, different terms hit. A term counts from its least number of hits on."""
    found = hits(text, a) if text else []
    if not found:
        return 0.0, 0.0, 0.0
    times = Counter(h[2] for h in found)
    found = [h for h in found if times[h[2]] >= least.get(h[2], 1)]
    total = sum(h[3] for h in found)
    return math.log1p(total), math.log1p(100 * total / (20 + len(text.split()))), math.log1p(len({h[2] for h in found}))


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, toxic) of the learning rows: at most ``most`` labelled ids, the first by a hash of theirs; an id labelled twice is toxic if either label says so, and of an id's texts the first in order is read."""
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(some), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


STEMS = (4, 5, 6)


TIMES = 3


def parts(text: str) -> set[tuple[str, int]]:
    """The folded words of a text, and their stems of STEMS letters with a * behind, each with 1 up to how often it occurs, TIMES at most."""
    n: Counter = Counter()
    for w, k in Counter(w for w in fold(seen(text)).replace(".", " ").split() if len(w) > 2).items():
        n[w] += k
        for s in STEMS:
            if len(w) > s:
                n[f"{w[:s]}*"] += k
    return {(w, i) for w, k in n.items() for i in range(1, min(k, TIMES) + 1)}


def learn_terms(sample: DataFrame, least: int = 6, odds: float = 4.0) -> dict[str, tuple[float, int]]:
    """Words and stems that tell toxic texts: term to (weight, occurrences from which it counts).

    Taken are those found so often in ``least`` toxic texts or more, and one in 50 of them, that are exp(odds) times as
    usual there as elsewhere; the weight is that log ratio. What a taken stem covers is left out. Counts are made on
    the executors; the driver sees what passes ``least``, which the size of the sample bounds.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: list[Counter] = [Counter(), Counter()]
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                n[y > 0].update({("", 0), *parts(t or "")})
            keys = list(n[0] | n[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.int32()), *(pa.array([k[w] for w in keys], pa.int64()) for k in n)], names=["word", "times", "n0", "n1"]
            )

    df = sample.select("text", "toxic").mapInArrow(counts, "word string, times int, n0 long, n1 long").groupBy("word", "times").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rows = {(r[0], r[1]): (r[2], r[3]) for r in df.where((F.col("word") == "") | (F.col("n1") >= least)).collect()}
    t0, t1 = rows.pop(("", 0), (0, 0))
    ratio = {w: math.log((b + 0.1) / (t1 + 1)) - math.log((a + 0.1) / (t0 + 1)) for w, (a, b) in rows.items() if b >= max(least, 0.02 * t1)}
    kept: dict[str, tuple[float, int]] = {}
    for w, i in sorted((w for w, r in ratio.items() if r >= odds), key=lambda w: (-rows[w][1], len(w[0]), w)):
        if w not in kept and not any(f"{w[:k]}*" in kept for k in STEMS if k < len(w.rstrip("*"))):
            kept[w] = (ratio[w, i], i)
    return kept


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method, with an intercept in front."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, most_labelled: int = 6000, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of doc_id, text; labels has doc_id, toxic.

    A term is a whole word, or the stem of words if it ends in *. Labels of ids whose crc32 leaves 1 modulo 3 are never looked at. At most most_labelled labelled texts teach further
    terms and the weights of the three measures; without toxic and harmless ones among them, fixed weights are used.
    Null and empty texts, and those without a hit, have the score of the intercept. A null doc_id is read as "" for
    the fold. Rows that repeat stay, an empty table gives no rows, and other columns are not read.
    """
    ship(docs.sparkSession)
    sample = labelled(docs, labels, most_labelled)
    weights = {_same(w): 4.0 for w in TERMS}
    least: dict[str, int] = {}
    for w, (r, times) in learn_terms(sample).items():
        weights.pop(w.rstrip("*"), None)
        weights[w], least[w] = min(6.0, r), times

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(weights)
        for b in batches:
            x = np.array([measures(t, a, least) for t in b.column("text").to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array(x[:, i]) for i in range(3))], names=["toxic", "a", "b", "c"])

    rows = np.array([tuple(r) for r in sample.select("text", "toxic").mapInArrow(measured, "toxic int, a double, b double, c double").collect()], float).reshape(-1, 4)
    both = len(rows) and 0 < rows[:, 0].sum() < len(rows)
    w = fit(rows[:, 1:], (rows[:, 0] > 0).astype(float)) if both else np.array([-4.0, 1.5, 1.5, 0.0])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(weights)
        for b in batches:
            x = np.array([measures(t, a, least) for t in b.column("text").to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
