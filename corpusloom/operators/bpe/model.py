"""Symbols, merges and the model document."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ...sources.sinks import atomic_json, read_json

#: The alphabet: printable ASCII in order, so that a base id is the code less 32 and the space is 0.
ALPHABET = [chr(c) for c in range(32, 127)]
ESCAPE = 1_000_000
#: A symbol with id i is the character OFFSET + i of a sequence kept as a string.
OFFSET = 0x10000


def chars_of(ids: list[int]) -> str:
    return "".join(chr(OFFSET + i) for i in ids)


@dataclass
class Symbols:
    """Strings by id; base characters that are new get the next id when they are first asked for."""

    strings: list[str] = field(default_factory=lambda: list(ALPHABET))

    def __post_init__(self):
        self.base = {s: i for i, s in enumerate(self.strings) if len(s) == 1}

    def id_of(self, ch: str) -> int:
        if ch not in self.base:
            self.base[ch] = len(self.strings)
            self.strings.append(ch)
        return self.base[ch]

    def merged(self, a: int, b: int) -> int:
        self.strings.append(self.strings[a] + self.strings[b])
        return len(self.strings) - 1

    def words_spanned(self, a: int, b: int) -> int:
        return self.strings[a].count(" ") + self.strings[b].count(" ") + 1

    def __len__(self) -> int:
        return len(self.strings)


Merge = tuple[int, int, int]


@dataclass
class Model:
    """A learned vocabulary: symbols, and the merges of both stages in order."""

    strings: list[str]
    stage1: list[Merge]
    stage2: list[Merge]

    @property
    def merges(self) -> list[Merge]:
        return self.stage1 + self.stage2

    @property
    def ranks(self) -> dict[tuple[int, int], tuple[int, int]]:
        return {(a, b): (r, n) for r, (a, b, n) in enumerate(self.merges)}

    @property
    def escape(self) -> int:
        """Ids from here on stand for characters that the alphabet does not have."""
        return len(self.strings) + ESCAPE

    def at(self, size: int) -> Model:
        """The model as it was when it had ``size`` symbols: a snapshot is a prefix of the merges."""
        first = [m for m in self.stage1 if m[2] < size], [m for m in self.stage2 if m[2] < size]
        return Model(self.strings[:size], *first)

    def document(self) -> dict:
        return {
            "symbol_str": self.strings,
            "stage1_merges": [list(m) for m in self.stage1],
            "stage2_merges": [list(m) for m in self.stage2],
            "space_id": 0,
            "stage1_vocab_size": len(ALPHABET) + len(self.stage1),
            "vocab_size": len(self.strings),
        }

    def save(self, path: str) -> None:
        atomic_json(path, self.document())

    @classmethod
    def load(cls, path: str) -> Model:
        d = read_json(path)
        return cls(d["symbol_str"], [tuple(m) for m in d["stage1_merges"]], [tuple(m) for m in d["stage2_merges"]])

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(id, str, n_spaces) and (rank, stage, a, b, new_id)."""
        vocab = spark.createDataFrame([(i, s, s.count(" ")) for i, s in enumerate(self.strings)], "id int, str string, n_spaces int")
        merges = [(r, 1 if r < len(self.stage1) else 2, *m) for r, m in enumerate(self.merges)]
        return vocab, spark.createDataFrame(merges, "rank int, stage int, a int, b int, new_id int")
