"""The text functions under names for SQL."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, UserDefinedTableFunction

from ..operators.bpe.codec import FEW_MERGES, TOGETHER, BatchCodec, Codec, Strings, parts_of
from ..operators.bpe.model import Model
from ..session import ship
from .normalize import normalize_text


def register(spark: SparkSession, model: Model | None = None) -> None:
    """preprocess_text(text); with a model also bpe_encode(text), bpe_decode(ids) and the table functions bpe_tokens(text) and bpe_token_counts(TABLE(...) PARTITION BY ..., column)."""
    ship(spark)

    @F.arrow_udf("string")
    def preprocess(texts: pa.Array) -> pa.Array:
        return pa.array(map(normalize_text, texts.to_pylist()), pa.string())

    spark.udf.register("preprocess_text", preprocess)
    if model is None:
        return
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = BatchCodec(shared.value, FEW_MERGES)  # once for a partition, with the words it has met
        for texts in batches:
            out = [pa.array([], pa.list_(pa.int32()))]
            for part in parts_of([pa.RecordBatch.from_arrays([texts], names=["text"])], "text"):
                flat, at = codec.lists(part.column(0))
                out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()), mask=part.column(0).is_null()))
            yield pa.concat_arrays(out)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        strings = Strings(shared.value)
        for ids in batches:
            yield strings.joined(ids)

    class Tokens:
        """One row for each token of a text."""

        def __init__(self):
            self.codec = Codec(shared.value)

        def eval(self, text: str):
            for k, i in enumerate(self.codec.encode(text) if text is not None else ()):
                yield k, i, self.codec.string(i)

    class TokenCounts:
        """Tokens of the texts of a table's partition, counted: a row for each token with the partition's first row's other columns.

        The result has the table's columns but for the text, then id, token and n. PARTITION BY says what is counted together: with a column of the caller's own
        (a bucket of ids) a large language is many partitions, whose counts add up. Texts are encoded together, TOGETHER characters at a time; counts of one partition are
        as many as the vocabulary has symbols.
        """

        def __init__(self):
            self.codec, self.model = BatchCodec(shared.value, FEW_MERGES), shared.value
            self.texts: list[str] = []
            self.chars, self.keys, self.n = 0, None, Counter()

        @staticmethod
        def analyze(rows: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or column.value not in [f.name for f in rows.dataType.fields]:
                raise ValueError(f"bpe_token_counts needs a table, and the name of its text column (got {column.value})")
            more = [StructField("id", LongType()), StructField("token", StringType()), StructField("n", LongType())]
            return AnalyzeResult(StructType([*[f for f in rows.dataType.fields if f.name != column.value], *more]))

        def eval(self, row, column: str):
            if self.keys is None:
                self.keys = tuple(v for k, v in row.asDict(recursive=False).items() if k != column)
            if text := row[column]:
                self.texts.append(text)
                self.chars += len(text)
                if self.chars >= TOGETHER:
                    self.counted()

        def counted(self):
            if self.texts:
                flat, _ = self.codec.lists(pa.array(self.texts, pa.string()))
                n = np.bincount(flat)
                at = np.flatnonzero(n)
                self.n.update(dict(zip(at.tolist(), n[at].tolist(), strict=True)))
            self.texts, self.chars = [], 0

        def terminate(self):
            self.counted()
            string = Codec(self.model).string
            for i, n in sorted(self.n.items()):
                yield (*self.keys, i, string(i), n)

    spark.udf.register("bpe_encode", encode)
    spark.udf.register("bpe_decode", decode)
    table: UserDefinedTableFunction = F.udtf(Tokens, returnType="place int, id int, token string")
    spark.udtf.register("bpe_tokens", table)
    spark.udtf.register("bpe_token_counts", F.udtf(TokenCounts))
