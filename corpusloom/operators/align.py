"""Two tokenisations of the same texts side by side: where their boundaries agree, and which tokens stand for which in between."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import ship
from .bpe.codec import BatchCodec, Words, parts_of
from .bpe.model import Model


def lengths(model: Model, ids: np.ndarray) -> np.ndarray:
    """Characters of each token; an escaped character is one."""
    n = np.array([len(s) for s in model.strings], np.int64)
    return np.where(ids < len(n), n[np.minimum(ids, len(n) - 1)], 1)


class Sweep:
    """The tokens of a batch of texts by two codecs, as ends on one line of all characters, and the segments between the ends that both have."""

    def __init__(self, texts: pa.Array, old: BatchCodec, new: BatchCodec):
        self.ids, self.ends, self.upto = [], [], []
        split = Words.split(texts)
        for codec in (old, new):
            flat, at = codec.lists(texts, split)
            self.ids.append(flat)
            self.ends.append(np.cumsum(lengths(codec.model, flat)))
            self.upto.append(at)
        # both are sorted, and each text's end is in both; so segments never cross texts
        there = np.zeros((2, max([int(e[-1]) for e in self.ends if len(e)], default=0) + 1), bool)
        for k, e in enumerate(self.ends):
            there[k, e] = True
        self.last = [np.flatnonzero(there[1 - k, e]) for k, e in enumerate(self.ends)]  # the tokens that end the segments
        self.count = [np.diff(x, prepend=-1) for x in self.last]

    def per_text(self) -> list[np.ndarray]:
        """old tokens, new tokens, shared ends and tokens that are the same in both, by text."""
        tokens = [np.diff(x) for x in self.upto]
        of = np.searchsorted(self.upto[0], self.last[0], "right") - 1  # the text in which a segment ends
        n = len(self.upto[0]) - 1
        same = (self.count[0] == 1) & (self.count[1] == 1)
        return [*tokens, np.bincount(of, minlength=n), np.bincount(of[same], minlength=n)]

    def replaced(self) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
        """The old and the new tokens of each segment that is not one token in both."""
        for s in np.flatnonzero((self.count[0] != 1) | (self.count[1] != 1)).tolist():
            yield tuple(tuple(self.ids[k][self.last[k][s] - self.count[k][s] + 1 : self.last[k][s] + 1].tolist()) for k in (0, 1))


def alignment(lines: DataFrame, old: Model, new: Model, *by: str) -> DataFrame:
    """(columns ``by``, old_tokens, new_tokens, shared_ends, same_tokens) over all lines (text): a token is the same where both have one from the same place to the same place.

    Lines are read once and encoded by both; only numbers leave the workers. A null or empty text has no token.
    """
    spark = ship(lines.sparkSession)
    models = spark.sparkContext.broadcast((old, new))
    names = ["old_tokens", "new_tokens", "shared_ends", "same_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = [BatchCodec(m) for m in models.value]
        for b in parts_of(batches, "text"):
            counts = [pa.array(x.astype(np.int64)) for x in Sweep(b.column("text"), *codecs).per_text()]
            yield pa.RecordBatch.from_arrays([*map(b.column, by), *counts], names=[*by, *names])

    rows = lines.select(*by, "text")
    each = rows.mapInArrow(run, StructType([*rows.select(*by).schema.fields, *[StructField(c, LongType()) for c in names]]))
    return each.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def replacements(lines: DataFrame, old: Model, new: Model, k: int = 25) -> DataFrame:
    """(old, new, n): the k most frequent replacements of tokens (strings, joined by |) by others over all lines, of equal ones in their order."""
    spark = ship(lines.sparkSession)
    models = spark.sparkContext.broadcast((old, new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = [BatchCodec(m) for m in models.value]

        def name(m: Model, ids: tuple[int, ...]) -> str:
            return "|".join(m.strings[i] if i < len(m.strings) else chr(i - m.escape) for i in ids)

        for b in parts_of(batches, "text"):
            n = Counter(Sweep(b.column("text"), *codecs).replaced())
            rows = [(name(codecs[0].model, x), name(codecs[1].model, y), c) for (x, y), c in n.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["old", "new", "n"])

    found = lines.select("text").mapInArrow(run, "old string, new string, n long").groupBy("old", "new").agg(F.sum("n").alias("n"))
    return found.orderBy(F.desc("n"), "old", "new").limit(k)
