"""Encoding with a public tokenizer, a white-space word at a time."""

from __future__ import annotations

import json
import re
import string
import sys
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

try:
    import public_tokenizers
except ImportError:  # the folder of vocabulary files is then given by path
    public_tokenizers = None

WORD_BPE = "word_bpe_49k.json"
assert sys.byteorder == "little" and array("I").itemsize == 4, "ids are written as they lie in memory"
_ENCODERS: dict[str, "Encoder"] = {}


def vocabulary(name: str = WORD_BPE) -> str:
    if public_tokenizers is None:
        raise FileNotFoundError(f"no public_tokenizers package; give the path of {name}")
    return public_tokenizers.path(name)


#: Signs between an ASCII letter and a space are a piece of their own, for the vocabulary never joins them with letters.
_SIGN, _LETTER = (np.isin(np.arange(256), np.frombuffer(x, "u1")) for x in (string.punctuation.encode(), string.ascii_letters.encode()))
_SPACE = 32
#: Words that normalising leaves alone and that no pattern splits: lower-case letters of Latin-1.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """The ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and never joins what it separates, so a text's ids are those of its pieces between
    spaces and line ends, and pieces recur. Other white space stays inside a piece and is left to the library. A text of
    Latin-1 is lowered first, as the tokenizer would, and signs behind words are set apart; neither where a special token
    may stand, which is told by its case and signs. New pieces go to the library: plain words many at a time, to a
    tokenizer of the same vocabulary without its normaliser, which would change nothing, and with the signs that stand for
    bytes put in beforehand; all others as they are. Pieces are kept in two generations of ``most``: when the younger is
    full it becomes the older one, and what the older one had and was not asked for since is forgotten. Texts are cut, and
    ids put together, in arrays of a batch's bytes: only a batch's different pieces are Python's objects.
    """

    def __init__(self, path: str, most: int = 350_000, longest: int = 48):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}  # the vocabulary's signs for the bytes of letters beyond ASCII
        vocab = self.words.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.most, self.longest = most, longest
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def pieces(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The pieces of all texts one after another, and how many there are up to the end of each text."""
        marked = [t is not None and "<|" in t for t in texts]
        lowered = [(t if m or not (t.isascii() or _latin(t)) else t.lower()) if t else "" for t, m in zip(texts, marked, strict=True)]
        raw = [t.encode() for t in lowered]
        stops = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        here = np.frombuffer(b" ".join([*raw, b""]).replace(b"\n", b" "), "u1")
        space, sign = here == _SPACE, _SIGN[here]
        last = space.copy()  # of a piece, with the space behind it
        edges = np.flatnonzero(sign[1:] != sign[:-1]) + 1  # the last byte is a space, so a run of signs ends where one begins
        if sign[0]:
            edges = edges[1:]
        first, behind = edges[::2], edges[1::2]
        apart = first[_LETTER[here[first - 1]] & space[behind]]
        if any(marked):
            apart = apart[~np.array(marked)[np.searchsorted(stops, apart, "right")]]
        last[apart - 1] = True
        ends = np.flatnonzero(last) + 1
        offsets = np.zeros(len(ends) + 1, np.int64)
        offsets[1:] = ends - np.cumsum(space[ends - 1])
        words = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(here[~space]))
        return words.dictionary_encode(), np.searchsorted(ends, stops, "right")

    def learn(self, new: list[str]) -> dict[str, bytes]:
        young, plain = {}, []
        rest = [p for p in new if not (_PLAIN.fullmatch(p) and not plain.append(p))]
        for i in range(0, len(rest), 8192):
            part = rest[i : i + 8192]
            for p, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                young[p] = array("I", e.ids).tobytes()
        for i in range(0, len(plain), 1024):
            part = plain[i : i + 1024]
            ids = array("I", self.words.encode_batch_fast([" ".join(part).translate(self.signs)], add_special_tokens=False)[0].ids)
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()  # each plain word ends in one such id, or zip() fails
            ids = ids.tobytes()
            young.update(zip(part, (ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True))
        self.young.update((p, ids) for p, ids in young.items() if len(p) <= self.longest)
        return young

    def encode_all(self, texts: list[str | None], most_chars: int = 1 << 21) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < most_chars):
                size += len(texts[end] or "")
                end += 1
            out += self._encode(texts[at:end])
            at = end
        return out

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        """Each different piece is looked up once in all that is known, and the others are learnt."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {"": b""}
        words, upto = self.pieces(texts)
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist()
        found = list(map(self.young.get, different))
        for k in [k for k, ids in enumerate(found) if ids is None]:
            if (ids := self.old.get(different[k])) is not None:
                found[k] = self.young[different[k]] = ids
        unknown = [k for k, ids in enumerate(found) if ids is None]
        learnt = self.learn([different[k] for k in unknown])
        for k in unknown:
            found[k] = learnt[different[k]]
        ids = pa.array(found, pa.large_binary()).take(words.indices)
        _, offsets, held = ids.buffers()
        stops = np.frombuffer(offsets, np.int64)[upto].tolist()
        held = memoryview(held or b"")
        return [bytes(held[a:b]) for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


def encoder(path: str) -> Encoder:
    """One for each worker process; what it has learnt lasts from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
