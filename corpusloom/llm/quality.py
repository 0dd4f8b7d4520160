"""Quality: overlapping heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer of the posterior labels."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import table

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(0xC0, 0x100))  # a byte from C0 on begins a character beyond ASCII
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "_.,'-\"()")
MEASURES = ("upper", "signs", "repeats", "lines", "variety", "letters", "bars")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def measure(text: bytes | None) -> tuple[int, list[float]]:
    """Words, and what the labellers look at: upper case among letters; signs, words equal to the one before, bars for each word; lines and words met before, as shares; letters for each word."""
    text = text or b""
    w = words_of(text)
    n = max(1, len(w))
    letters = len(text) - len(text.translate(None, _LETTERS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(w), [
        (len(text) - len(text.translate(None, _UPPER))) / max(1, letters),
        (len(text) - len(text.translate(None, _SIGNS))) / n,
        sum(map(eq, w, w[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(w)) / n,
        letters / n,
        text.count(b"|") / n,
    ]


#: Labellers that know bad documents: (measure, from this value on, words at least); below it they have no vote.
BAD = (("upper", 0.3, 8), ("signs", 0.3, 8), ("repeats", 0.1, 10), ("lines", 0.3, 8), ("variety", 0.6, 20), ("letters", 9.0, 8), ("bars", 0.1, 8))
#: Labellers that know good ones: all these measures up to this value, or a text too short to tell; else no vote.
GOOD = ((("upper", 0.1), ("signs", 0.1)), (("repeats", 0.03), ("variety", 0.5)), (("lines", 0.05), ("letters", 7.5), ("bars", 0.01)))
SHORT = 8


def votes(n: int, m: list[float]) -> list[int]:
    """1 good, -1 bad, 0 no vote, by labeller."""
    of = dict(zip(MEASURES, m, strict=True))
    bad = [-1 if n >= least and of[k] >= x else 0 for k, x, least in BAD]
    return bad + [1 if n < SHORT or all(of[k] <= x for k, x in g) else 0 for g in GOOD]


def pattern(v: list[int]) -> int:
    return sum(1 << i for i, x in enumerate(v) if x)


def votes_of(p: int) -> list[int]:
    return [p >> i & 1 for i in range(len(BAD) + len(GOOD))]


def label_model(patterns: dict[int, int], rounds: int = 300) -> tuple[float, np.ndarray, dict[int, float]]:
    """From the counts of vote patterns: the share of good documents, each labeller's rate of voting among (good, bad) ones, and P(good) by pattern.

    Each labeller votes one way or not at all, and its accuracy is how its rates differ between the classes; given the
    class, labellers are taken as independent. Expectation and maximisation alternate until nothing moves, from where
    any vote for bad makes a document bad, which names the classes. Pseudo-counts keep rates off 0 and 1.
    """
    keys = sorted(patterns)
    v = np.array([votes_of(p) for p in keys], float).reshape(-1, len(BAD) + len(GOOD))
    c = np.array([patterns[p] for p in keys], float)
    post = np.where(v[:, : len(BAD)].any(1), 0.1, 0.95)
    share, rate = 0.5, np.full((2, v.shape[1]), 0.5)
    for _ in range(rounds):
        g, b = c * post, c * (1 - post)
        share = float(np.clip((g.sum() + 0.5) / (c.sum() + 1), 0.01, 0.99))
        rate = np.array([(x @ v + 0.5) / (x.sum() + 1) for x in (g, b)]).clip(1e-5, 1 - 1e-5)
        good, bad = (v @ np.log(r) + (1 - v) @ np.log1p(-r) for r in rate)
        new = 1 / (1 + np.exp(np.clip(bad + np.log1p(-share) - good - np.log(share), -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return share, rate.T, dict(zip(keys, post.tolist(), strict=True))


DIM = 1 << 12


def _shape(word: bytes) -> int:
    """A word's slot: case, length and what surrounds its letters, hashed."""
    core = word.strip(_SIGNS + b".,'-\"()_")
    case = "U" if core.isupper() else "L" if core.islower() else "T" if core.istitle() else "M"
    front, back = word[: word.find(core)] if core else word, word[word.rfind(core) + len(core) :] if core else b""
    return zlib.crc32(f"{case}{min(len(core) // 4, 4)}{front[:2]}{back[:3]}".encode()) % DIM


class Shapes(dict):
    """Slots of words seen, with a bound on what is kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = s = _shape(word)
        return s


def features(text: bytes | None, n: int, m: list[float], shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: the share of each word shape, and each measure's step on a scale of powers of two, hashed into DIM slots."""
    count = Counter(map(shapes.__getitem__, words_of(text)))
    steps = [zlib.crc32(f"{k}:{int(np.ceil(2 * np.log2(x + 1e-3)))}".encode()) % DIM for k, x in zip(MEASURES, m, strict=True)]
    slots = np.array([*count, *steps, zlib.crc32(f"words:{n.bit_length()}".encode()) % DIM], np.int64)
    return slots, np.array([*(c / max(1, n) for c in count.values()), *[0.5] * (len(steps) + 1)])


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 400, rate: float = 0.05, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels by Adam over the whole sample; the intercept comes last."""
    row = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    slot, value = np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows])
    w, m1, m2 = (np.zeros(DIM + 1) for _ in range(3))
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[slot], len(rows)) + w[DIM]
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(slot, value * err[row], DIM) / len(rows), err.mean()) + ridge * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return w


def quality(docs: DataFrame, sample_docs: int = 5000, threshold: float = 0.5, filtering: bool = False) -> DataFrame:
    """(doc_id, n_words, weak_label, score, kept) for each row: weak_label is the labellers' posterior, score that of the linear scorer, kept whether it is ``threshold`` or more. With filtering, the rows that are kept, as they are.

    The label model counts the vote patterns of all documents (1,024 at most reach the driver). The scorer is fitted
    on the features (bytes, not texts) of about sample_docs different documents, the first by a hash of doc_id and text,
    twice as many at most: so the result does not depend on how rows are dealt. No labels are read. A text that is null,
    empty or without words has the score 0 and is not kept. Rows that repeat stay, a null doc_id stays null, an empty
    table gives no rows, and other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def texts(b: pa.RecordBatch) -> list[bytes | None]:
        return b.column("text").cast(pa.binary()).to_pylist()

    def small(batches: Iterator[pa.RecordBatch], n: int = 512) -> Iterator[pa.RecordBatch]:
        return (b.slice(k, n) for b in batches for k in range(0, b.num_rows, n))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter(pattern(votes(*measure(t))) for b in small(batches) for t in texts(b))
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.int64()), pa.array(n.values(), pa.int64())], names=["pattern", "n"])

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Features as bytes, which is a tenth of what lists of numbers take on the driver; texts stay where they are read."""
        shapes = Shapes()
        for b in small(batches):
            m = [(t, *measure(t)) for t in texts(b)]
            x = [features(t, n, k, shapes) for t, n, k in m]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array([pattern(votes(n, k)) for _, n, k in m], pa.int64()), pa.array([s.astype("<i2").tobytes() for s, _ in x], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in x], pa.binary())],
                names=["key", "pattern", "slots", "vals"],
            )

    counted = docs.select("text").mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n")).collect()
    total = sum(r[1] for r in counted)
    _, _, post = label_model({r[0]: r[1] for r in counted})
    share = min(1.0, sample_docs / max(1, total))
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    drawn = docs.select(key.alias("key"), "text").where(F.pmod("key", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    some = drawn.mapInArrow(sampled, "key long, pattern long, slots binary, vals binary").dropDuplicates(["key"]).orderBy("key").limit(2 * sample_docs).drop("key").collect()
    w = train([(np.frombuffer(r[1], "<i2").astype(np.int64), np.frombuffer(r[2], "<f4").astype(float)) for r in some], np.array([post[r[0]] for r in some])) if some else np.zeros(DIM + 1)

    def judged(b: pa.RecordBatch, shapes: Shapes) -> tuple[list[int], list[float], list[float]]:
        size, weak, score = [], [], []
        for t in texts(b):
            n, m = measure(t)
            s, v = features(t, n, m, shapes)
            size.append(n)
            weak.append(post[pattern(votes(n, m))])
            score.append(float(1 / (1 + np.exp(-np.clip(w[s] @ v + w[DIM], -30, 30)))) if n else 0.0)
        return size, weak, score

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in small(batches):
            size, weak, score = judged(b, shapes)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(weak, pa.float64()), pa.array(score, pa.float64())], names=["doc_id", "n_words", "weak_label", "score"])

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in small(batches):
            yield b.filter(pa.array([x >= threshold for x in judged(b, shapes)[2]], pa.bool_()))

    if filtering:
        return rows.mapInArrow(filtered, rows.schema)
    out = docs.mapInArrow(scored, "doc_id long, n_words long, weak_label double, score double")
    return out.withColumn("kept", F.col("score") >= threshold)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
