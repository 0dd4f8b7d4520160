"""Stage 1 by a table of words: each different word of all units is encoded once in the job, and joined back to where it stands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ...session import cut, ship
from .codec import Words, codes, encode, parts_of
from .model import OFFSET, Model, chars_of

#: A word with more than one in so many of all places is frequent: there are fewer than that many of them.
FREQUENT = 256
#: Characters of the units whose words are looked up together, but for one unit that has more.
BLOCK = 1 << 21


def word_table(units: DataFrame, model: Model) -> DataFrame:
    """(word, places, ids): the different words of units (unit string), how many places each has, and its ids by stage 1, a character each."""
    words = units.select(F.explode(F.split("unit", " ", -1)).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("places"))
    return _encoded(words, model)


def _encoded(words: DataFrame, model: Model) -> DataFrame:
    return encode(words, Model(model.strings, model.stage1, []), "word", as_chars=True)


def encode_by_words(units: DataFrame, model: Model, table: DataFrame | None = None, as_chars: bool = True) -> DataFrame:
    """Adds ids, a character each or as an array, to (unit, ...): the words of a unit as the table has them, with a space between all parts.

    Units are numbered in blocks of some BLOCK characters, and what is shuffled by word is each block's different words and not their places, so that a word is at most as many rows
    as there are blocks; its frequent words, fewer than FREQUENT, are broadcast. The rest of the table is never broadcast. A block and its words with their ids come together in one task, which puts its units
    together. A word that the table lacks is an error. Null and empty units are left as they are.
    """
    ship(units.sparkSession)
    block = StructField("block", LongType())

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for i, b in enumerate(parts_of(batches, "unit", BLOCK)):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, first + i))], names=[*b.schema.names, "block"])

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("block").to_numpy()
            for k in np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]).tolist():
                here = b.column("unit").slice(k, int(np.searchsorted(at, at[k], "right")) - k)
                _, words, of = Words.split(here.drop_null())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), at[k])), pa.array(words, pa.string()), pa.array(np.bincount(of, minlength=len(words)))], names=["block", "word", "n"])

    rows = cut(units.mapInArrow(numbered, StructType([*units.schema.fields, block])))  # written, so that numbers stay
    words = cut(rows.select("block", "unit").mapInArrow(different, "block long, word string, n long").where("word <> ''"))
    table = cut(table if table is not None else _encoded(words.groupBy("word").agg(F.sum("n").alias("places")), model))
    total = table.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    frequent = F.col("places") * FREQUENT > F.lit(total)
    hot = table.where(frequent).select(F.col("word").alias("hot_word"), F.col("ids").alias("hot_ids"))
    marked = words.join(F.broadcast(hot), F.col("word") == F.col("hot_word"), "left")
    here = marked.where("hot_word IS NOT NULL").select("block", "word", F.col("hot_ids").alias("ids"))
    found = marked.where("hot_word IS NULL").select("block", "word").join(table.where(~frequent).select("word", "ids"), "word", "left")
    missing = F.raise_error(F.concat(F.lit("the table lacks the word "), F.col("word"))).cast("string")
    known = here.unionByName(found.select("block", "word", F.coalesce("ids", missing).alias("ids")))
    space = chars_of([0])

    def lined(block_: pa.Table, known_: pa.Table) -> pa.Table:
        units_ = block_.column("unit").combine_chunks()
        at, words_, of = Words.split(units_)
        ids = pa.concat_arrays([*known_.column("ids").cast(pa.string()).chunks, pa.array([""], pa.string())])  # the last one is the empty word's, which no other has
        place = pc.index_in(pa.array(words_, pa.string()), known_.column("word").combine_chunks().cast(pa.string()))
        parts = pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids.take(pc.fill_null(place, len(ids) - 1).take(pa.array(of))))
        text = pc.if_else(units_.is_null(), None, pc.binary_join(parts, space))
        if not as_chars:
            ends = np.cumsum(pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False))
            flat = pa.array(codes(text).astype(np.int32) - OFFSET, pa.int32())
            text = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat, mask=text.is_null())
        return block_.drop_columns("block").append_column("ids", text)

    schema = StructType([*units.schema.fields, StructField("ids", StringType() if as_chars else ArrayType(IntegerType()))])
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lined, schema)
