import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import order_minhash as om

DOCS = "doc_id long, text string, lang string, kind int, at int, p int"


def mixed(x):
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64
    return x ^ x >> 32


def plain(text, scheme):
    """The signature a k-mer at a time, in Python's integers."""
    if not text:
        return [0] * scheme.size
    k = min(scheme.k, len(text))
    more = int(om._MORE)
    h = []
    for i in range(len(text) - k + 1):
        x = 0
        for c in text[i : i + k]:
            x = (x * more + ord(c)) % 2**64
        h.append(mixed(x))
    seen, pairs = {}, []
    for x in h:
        pairs.append(mixed((x + more * seen.get(x, 0)) % 2**64) >> 32)
        seen[x] = seen.get(x, 0) + 1
    out = []
    for mask, factor in zip(scheme.mask[:, 0].tolist(), scheme.factor[:, 0].tolist(), strict=True):
        least = sorted(sorted(range(len(h)), key=lambda i: ((pairs[i] ^ mask) * factor % 2**32, i))[: scheme.tuple])
        x = len(least)
        for i in least:
            x = mixed((x * more + h[i]) % 2**64)
        out.append(x >> 48)
    return out


def chain(rows, scheme):
    """Rows of edited_likeness() by sorting all documents in one place."""
    known = sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda r: (-r[0], r[1]))
    after = {r: known[(k + 1) % len(known)] for k, r in enumerate(known)}
    out = []
    for i, t in rows:
        t = t or ""
        cut, nxt = len(t) // 3, after[i, t][1] if i is not None else t
        edited = t if i is None else t[: len(t) - cut] + nxt[:cut]
        a, b, c = (scheme.of(x) for x in (t, edited, nxt))
        out.append((i, len(t), edited, om.hex_of(a), om.hex_of(b), om.likeness(a, b), om.likeness(a, c) if i is not None else None))
    return sorted(out, key=repr)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.integers(1, 9), st.integers(1, 4))
def test_signature_is_the_plain_one(text, k, tuple_):
    s = om.OrderMinHash(k, tuple_, 5)
    assert s.of(text).tolist() == plain(text, s)


def test_repeated_and_long_texts(monkeypatch):
    monkeypatch.setattr(om, "BLOCK", 7)
    s = om.OrderMinHash(3, 3, 6)
    for text in ("ab" * 40, "x" * 100, "abcdefgh" * 9 + "abc"):
        assert s.of(text).tolist() == plain(text, s)


def test_order_counts():
    """Swapping halves keeps the k-mers but for a few and changes their order; a changed word costs little."""
    s, r = om.OrderMinHash(), np.random.default_rng(0)
    words = ["".join(map(chr, r.integers(97, 123, 7))) for _ in range(400)]
    text = " ".join(words)
    swapped = " ".join(words[200:] + words[:200])
    changed = " ".join(["other" if i == 100 else w for i, w in enumerate(words)])
    like = lambda t: om.likeness(s.of(text), s.of(t))
    assert like(text) == 1 and like(changed) > 0.9 and 0.3 < like(swapped) < 0.7 and like(" ".join(reversed(words))) < 0.3


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_chain_of_documents(spark, parts):
    r = np.random.default_rng(parts)
    rows = [(int(i), " ".join(f"w{x}" for x in r.integers(0, 40, n))) for i, n in zip(r.permutation(500)[:60] - 100, r.integers(0, 90, 60), strict=True)]
    rows += [(rows[0][0], "same id, other text"), rows[1], rows[1], (7000, None), (7001, ""), (7002, "é" * 3000), (7003, "ab"), (None, "no id at all"), (None, None), (None, "no id at all")]
    docs = spark.createDataFrame([(i, t, "en", 1, 2, 3) for i, t in rows], DOCS)
    scheme = om.OrderMinHash()
    got = sorted(map(tuple, om.edited_likeness(docs, parts=parts).collect()), key=repr)
    assert got == chain(rows, scheme)


def test_one_document_and_none(spark):
    schema = "doc_id long, text string"
    one = om.edited_likeness(spark.createDataFrame([(5, "abcdefghi")], schema)).collect()
    assert [(r.edited, r.near_next) for r in one] == [("abcdefabc", 1.0)]
    assert om.edited_likeness(spark.createDataFrame([], schema)).count() == 0
    assert om.edited_likeness(spark.createDataFrame([(None, "x")], schema)).first().near_next is None


def test_extreme_ids(spark):
    rows = [(2**63 - 1, "abc" * 9), (2**63 - 2, "bcd" * 9), (-(2**63), "cde" * 9), (0, "def" * 9), (2**53 + 1, "efg" * 9), (2**53, "fgh" * 9)]
    got = om.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string"), parts=4)
    assert sorted(map(tuple, got.collect()), key=repr) == chain(rows, om.OrderMinHash())


def test_fingerprints_and_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    of = {r.doc_id: (r.n_chars, r.fingerprint) for r in om.fingerprints(docs).collect()}
    got = om.op11_order_minhash(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    assert len(got) == len(ids) and {r.doc_id: (r.n_chars, r.fingerprint) for r in got} == of
    for r in got:
        t, other = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        cut = len(t) // 3
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - cut] + other[:cut]).encode()).hexdigest()
    long = [r for r in got if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.15


def test_similarity_in_the_jvm(spark):
    rows = spark.createDataFrame([("00010002", "00010003"), ("00010002", None), ("", ""), ("0001", "0001")], "a string, b string")
    assert [r.s for r in rows.select(om.similarity(rows.a, rows.b).alias("s")).collect()] == [0.5, None, None, 1.0]
