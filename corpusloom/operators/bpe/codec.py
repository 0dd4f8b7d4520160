"""Encoding and decoding: whole Arrow batches at once, single texts, and forms that stay in the JVM."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ...session import ship
from .chain import Chain, Ranks, encoded
from .model import OFFSET, Model, chars_of

_KNOWN_WORDS = 300_000
#: Up to so many merges are made in whole texts at nearly twice the speed of looking words up, and nothing is remembered.
FEW_MERGES = 64


def apply_merges(ids: Sequence[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merges by rank, of one rank from left to right. Long sequences go through a queue of positions, short ones by rescanning."""
    ids = list(ids)
    if len(ids) < 48:
        while len(ids) > 1:
            best = min((ranks[p] for p in zip(ids, ids[1:], strict=False) if p in ranks), default=None)
            if best is None:
                break
            new, out, i = best[1], [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ranks.get((ids[i], ids[i + 1])) == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids
    after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
    queue = [(ranks[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
    heapq.heapify(queue)
    while queue:
        hit, i = heapq.heappop(queue)
        j = after[i] if ids[i] >= 0 else -1
        if j < 0 or ranks.get((ids[i], ids[j])) != hit:
            continue
        ids[i], ids[j] = hit[1], -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        for left, right in ((before[i], i), (i, k)):
            if left >= 0 and right >= 0 and (next_ := ranks.get((ids[left], ids[right]))):
                heapq.heappush(queue, (next_, left))
    return [x for x in ids if x >= 0]


class Codec:
    """A model's encoder and decoder for texts. Lossless for any text: characters that the alphabet does not have are escaped."""

    def __init__(self, model: Model):
        self.strings, self.escape = model.strings, model.escape
        self.base = {s: i for i, s in enumerate(model.strings) if len(s) == 1}
        self.first = {(a, b): (r, n) for r, (a, b, n) in enumerate(model.stage1)}
        self.second = {(a, b): (r, n) for r, (a, b, n) in enumerate(model.stage2)}
        self.words: dict[str, list[int]] = {}

    def char(self, c: str) -> int:
        return self.base[c] if c in self.base else self.escape + ord(c)

    def word(self, w: str) -> list[int]:
        if w not in self.words:
            if len(self.words) > _KNOWN_WORDS:
                self.words.clear()
            self.words[w] = apply_merges([self.char(c) for c in w], self.first)
        return self.words[w]

    def encode(self, text: str) -> list[int]:
        """Stage 1 never joins a space, so words are encoded by themselves, once each; stage 2 then works on the line."""
        out: list[int] = []
        for k, w in enumerate(text.split(" ")):
            if k:
                out.append(0)
            out += self.word(w)
        return apply_merges(out, self.second) if self.second else out

    def decode(self, ids: Sequence[int]) -> str:
        return "".join(self.string(i) for i in ids)

    def string(self, i: int) -> str:
        if 0 <= i < len(self.strings):
            return self.strings[i]
        if not self.escape <= i <= self.escape + 0x10FFFF:
            raise ValueError(f"{i} is no id of this vocabulary")
        return chr(i - self.escape)


class Strings:
    """The texts of many lists of ids at once."""

    def __init__(self, model: Model):
        self.strings, self.escape = model.strings, model.escape

    def joined(self, ids: pa.Array, together: int | None = None) -> pa.Array:
        """The text of each list, null for null. Some ``together`` ids (none: TOGETHER) are looked up at a time; one outside the vocabulary is an error."""
        ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        out, at = [pa.array([], pa.string())], 0
        while at < len(ids):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (together or TOGETHER), "right")))
            out.append(self._joined(ids.slice(at, end - at)))
            at = end
        return pa.concat_arrays(out)

    def _joined(self, ids: pa.Array) -> pa.Array:
        flat = ids.flatten()
        if flat.null_count:
            raise ValueError("null is no id of this vocabulary")
        flat, n = flat.to_numpy().astype(np.int64), len(self.strings)
        bad = (flat < 0) | ((flat >= n) & ((flat < self.escape) | (flat > self.escape + 0x10FFFF)))
        if bad.any():
            raise ValueError(f"{flat[bad][0]} is no id of this vocabulary")
        escaped = np.unique(flat[flat >= n])
        places = np.where(flat < n, flat, n + np.searchsorted(escaped, flat))
        known = pa.array([*self.strings, *(chr(i - self.escape) for i in escaped.tolist())], pa.string())
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(at, known.take(pa.array(places)), mask=ids.is_null()), "")


class Tokenizer:
    """A model document as an encoder and decoder of lists of texts, without Spark."""

    def __init__(self, path: str):
        self.codec = Codec(Model.load(path))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.codec.encode(t) for t in texts]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.codec.decode(x) for x in ids]


#: Texts as words: see Words.split().
Split = tuple[np.ndarray, list[str], np.ndarray]


class Words:
    """The ids of words, each encoded once as long as it is remembered: new ones all together, known ones by a look-up of a batch's different words."""

    def __init__(self, chain, ranks: Ranks, most: int = _KNOWN_WORDS):
        self.chain, self.ranks, self.most, self.encoded = chain, ranks, most, 0
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.start = self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)  # each word with a space behind it

    def of(self, different: list[str]) -> np.ndarray:
        """Where each of some different words stands in the store."""
        if len(self.known) > self.most:
            self.clear()
        new = [w for w in different if w not in self.known]
        if new:
            chain = encoded(self.chain(pa.array(new, pa.string())), self.ranks)
            size = chain.counts()
            end = np.cumsum(size + 1)
            flat = np.zeros(int(end[-1]), np.int32)
            filled = np.ones(len(flat), bool)
            filled[end - 1] = False
            flat[filled] = chain.ids()
            self.start = np.concatenate([self.start, len(self.flat) + end - size - 1])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
            n = len(self.known)
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
            self.encoded += len(new)
        return np.fromiter(map(self.known.__getitem__, different), np.int64, len(different))

    @staticmethod
    def split(texts: pa.Array) -> Split:
        """Where the words of each text begin and the last one's end, the different words, and which of them each word is. Null is an empty text."""
        split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
        words = split.values.dictionary_encode()
        return split.offsets.to_numpy(), words.dictionary.to_pylist(), words.indices.to_numpy()

    def slots(self, split: Split) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word the number in the store, and its ids with the space behind it, which the last one of a text hasn't; and the ids of each text."""
        at, different, indices = split
        w = self.of(different)[indices]
        slots = self.size[w] + 1
        slots[at[1:] - 1] -= 1
        return w, slots, np.add.reduceat(slots, at[:-1]) if len(at) > 1 else np.zeros(0, np.int64)

    def chained(self, split: Split) -> Chain:
        """Texts as the ids of their words with a space, which is id 0, between them."""
        w, slots, sizes = self.slots(split)
        from_ = np.arange(int(sizes.sum()))
        from_ += np.repeat(self.start[w] - np.cumsum(slots) + slots, slots)
        return Chain(self.flat[from_], sizes)

    def counts(self, split: Split) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and how many of them are spaces."""
        return self.slots(split)[2], np.diff(split[0]).astype(np.int64) - 1


def joined(texts: pa.Array) -> pa.Buffer:
    """The bytes of all texts, end to end; a null has none."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], pc.fill_null(texts, "")), "")[0].as_buffer()


def codes(texts: pa.Array) -> np.ndarray:
    """The code points of all texts, end to end, out of the array's bytes; a null has none."""
    data = joined(texts)
    raw = np.frombuffer(data, np.uint8)
    return raw if not len(raw) or raw.max() < 0x80 else np.frombuffer(str(data, "utf-8").encode("utf-32-le"), "<u4")


class BatchCodec:
    """Encodes many texts at once: characters become ids by a table, and each merge is made in all texts together.

    Where stage 1 never joins a space, as it is learned, it works on different words alone, and stage 2 on the lines that these make; so
    time hardly grows with the number of merges: those of stage 1 meet new words only, and those of stage 2 a third of the symbols.
    Up to ``few`` merges are made in whole texts.
    """

    def __init__(self, model: Model, few: int = 0):
        self.model, self.ranks = model, Ranks(model.merges)
        self.table = np.arange(0x110000, dtype=np.int32) + model.escape
        for i, s in enumerate(model.strings):
            if len(s) == 1:
                self.table[ord(s)] = i
        plain = model.strings[:1] == [" "] and not any(" " in model.strings[x] for a, b, _ in model.stage1 for x in (a, b))
        self.words = Words(self.chain, Ranks(model.stage1)) if plain and len(model.merges) > few else None
        self.second = Ranks(model.stage2)

    def coded(self, texts: pa.Array, split: Split | None = None) -> Chain:
        """Texts with all merges made. split is what Words.split() gives, for texts that several codecs encode."""
        if self.words is None:
            return encoded(self.chain(texts), self.ranks)
        chain = self.words.chained(split or Words.split(texts))
        return encoded(chain, self.second) if self.second.merges else chain

    def chain(self, texts: pa.Array) -> Chain:
        sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
        return Chain(self.table[codes(texts)], sizes)

    def counts(self, texts: pa.Array, split: Split | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """The numbers of ids and of spaces by text where all merges are inside words, so that no text has to be put together; else nothing."""
        return None if self.words is None or self.second.merges else self.words.counts(split or Words.split(texts))

    def lists(self, texts: pa.Array, split: Split | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last one's end)."""
        chain = self.coded(texts, split)
        return chain.ids(), np.concatenate([[0], np.cumsum(chain.counts())]).astype(np.int32)


def sharing(codecs: list[BatchCodec]) -> list[BatchCodec]:
    """Codecs whose first stages are the same, made to remember words together."""
    known: dict[tuple, Words] = {}
    for c in codecs:
        if c.words is not None:
            c.words = known.setdefault((c.table.tobytes(), tuple(map(tuple, c.model.stage1))), c.words)
    return codecs


#: Characters that are encoded together, but for one text that has more: their symbols' arrays are held at once.
TOGETHER = 1 << 22


def parts_of(batches: Iterator[pa.RecordBatch], column: str, together: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut where the texts of a column have some ``together`` characters (none: TOGETHER)."""
    most = together or TOGETHER
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.utf8_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end


def encode(texts: DataFrame, model: Model, column: str = "text", as_chars: bool = False) -> DataFrame:
    """Adds ids, the tokens of a text column; null stays null. as_chars gives them as a string with a character for each id."""
    ship(texts.sparkSession)
    texts = texts.drop("ids")
    shared = texts.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*texts.schema.fields, StructField("ids", StringType() if as_chars else ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BatchCodec(shared.value, FEW_MERGES)
        for b in parts_of(batches, column):
            flat, at = codec.lists(b.column(column))
            null = b.column(column).is_null()
            if as_chars:  # characters from OFFSET on, each four bytes of UTF-8
                data = pa.py_buffer((flat + OFFSET).astype("<u4").tobytes().decode("utf-32-le").encode())
                ids = pc.if_else(null, None, pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer((4 * at).astype(np.int32)), data))
            else:
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()), mask=null)
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, "ids"])

    return texts.mapInArrow(run, schema)


def _chars(text: Column) -> Column:
    """A text's characters, without the empty part that an empty text has."""
    return F.array_remove(F.split(text, ""), "")


def _char(code: Column) -> Column:
    """The character of a code point; those of one byte need no decoder."""
    return F.when((code >= 0) & (code < 256), F.chr(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _literal(values: list, kind: str) -> Column:
    """A constant array that Catalyst folds into one value, whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def decode(encoded_: DataFrame, model: Model, column: str = "ids") -> DataFrame:
    """Adds decoded, the text of an id column, without Python; null stays null, and an id outside the vocabulary is an error."""
    strings, n, escape = _literal(model.strings, "string"), len(model.strings), model.escape

    def one(i: Column) -> Column:
        code = _char(i - escape)
        bad = F.raise_error(F.concat(i.cast("string"), F.lit(" is no id of this vocabulary"))).cast("string")
        return F.when((i >= 0) & (i < n), F.get(strings, i)).when((i >= escape) & (i <= escape + 0x10FFFF), code).otherwise(bad)

    return encoded_.withColumn("decoded", F.array_join(F.transform(column, one), ""))


def encode_native(text: Column, model: Model) -> Column:
    """The ids of a text without Python, for small vocabularies and texts of known characters: each merge is one replacement of strings."""
    known = [(s, i) for i, s in enumerate(model.strings) if len(s) == 1]
    base = F.translate(text, "".join(s for s, _ in known), chars_of([i for _, i in known]))
    for a, b, new in model.merges:
        base = F.replace(base, F.lit(chars_of([a, b])), F.lit(chars_of([new])))
    return F.transform(_chars(base), lambda c: F.ascii(c) - F.lit(OFFSET))


def encode_baseline(text: Column) -> Column:
    """Each character's code plus 1, and a 0 at the end."""
    return F.concat(F.transform(_chars(text), lambda c: F.ascii(c) + 1), F.array(F.lit(0)))


def decode_baseline(ids: Column) -> Column:
    """Zeros are dropped wherever they are."""
    return F.array_join(F.transform(ids, lambda i: F.when(i == 0, "").otherwise(_char(i - 1))), "")
