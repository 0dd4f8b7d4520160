"""Alignment of two tokenisations against offsets taken one text at a time."""

import random
from collections import Counter

import pyarrow as pa

from corpusloom.operators import align
from corpusloom.operators.bpe import codec as codecs
from corpusloom.operators.bpe.codec import Codec
from corpusloom.operators.bpe.distributed import train, train_words
from corpusloom.operators.bpe.model import ALPHABET, Model


def spans(codec, text):
    out, at = [], 0
    for i in codec.encode(text):
        s = codec.string(i)
        out.append((at, at + len(s), s))
        at += len(s)
    return out


def test_alignment_and_replacements(spark):
    r = random.Random(4)
    texts = [" ".join(r.choices(["to", "be", "or", "not", "tobe", "é", "bete", "no"], k=r.randint(0, 9))) for _ in range(80)] + ["", None, " ", "z\u0416 to  be"]
    rows = [("a" if k % 3 else None, t) for k, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "lang string, text string")
    some = lines.where("text <> ''")
    old, new = train(some, 4, 6, more=True), train_words(some, 9, more=True)
    want, moved = {}, Counter()
    for lang, t in rows:
        x, y = spans(Codec(old), t or ""), spans(Codec(new), t or "")
        ends = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        n = want.setdefault(lang, [0, 0, 0, 0])
        for k, v in enumerate((len(x), len(y), len(ends), len({s[:2] for s in x} & {s[:2] for s in y}))):
            n[k] += v
        for a, z in zip([0, *ends], ends, strict=False):
            parts = [[s for b, e, s in side if a <= b and e <= z] for side in (x, y)]
            if max(map(len, parts)) > 1:
                moved["|".join(parts[0]), "|".join(parts[1])] += 1
    got = align.alignment(lines.repartition(3), old, new, "lang").collect()
    assert {r.lang: list(r[1:]) for r in got} == want
    top = [(r.old, r.new, r.n) for r in align.replacements(lines.repartition(2), old, new, 5).collect()]
    assert top == [(*k, n) for k, n in sorted(moved.items(), key=lambda x: (-x[1], x[0]))][:5] and len(moved) > 5
    assert align.alignment(lines.where("lang = 'none'"), old, new).first().old_tokens == 0


def test_texts_are_split_once_for_both_codecs(monkeypatch):
    seen, split = [], codecs.Words.split
    monkeypatch.setattr(codecs.Words, "split", staticmethod(lambda texts: seen.append(1) or split(texts)))
    m = Model(list(ALPHABET), [], [])
    assert [x.tolist() for x in align.Sweep(pa.array(["ab", None, "a b"]), codecs.BatchCodec(m), codecs.BatchCodec(m)).per_text()] == [[2, 0, 3]] * 4
    assert len(seen) == 1
