import random
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import packing, tokenfile
from corpusloom.llm.tokens import Encoder, vocabulary

TEXTS = [
    "Hello, World! it's 3.14 e.g. don't\nx\ty",
    "",
    None,
    "naïve Élan ÜBER straße ﬁne é ＡＢＣ İstanbul ΣΑΣ",
    "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>",
    "word,. word's 's'' [x]_y a|b $$$ thnd*** end***",
    "  spaced   out \x1c\x85 　 text  ",
    "日本語 한국어 emoji 😀👍🏽 mix",
    "word " * 5000,
    "a" * 3000,
    "ª º µ ÿ ß",
]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary(), most=50)


def plain(encoder, text):
    return encoder.library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(encoder):
    for t, ids in zip(TEXTS, encoder.encode_all(TEXTS), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain(encoder, t)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" .,'!-sdt\nAbÉé<|>")), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_encoder_equals_the_library_on_any_text(encoder, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain(encoder, text)


def test_recurring_pieces_are_taken_once_a_batch(encoder):
    texts = [" ".join(random.Random(k).choices([f"word{chr(97 + i)}" for i in range(26)], k=20_000)) for k in range(40)]
    words, upto = encoder.pieces(texts)
    assert len(words) == 800_000 and len(words.dictionary) == 26 and upto.tolist() == [20_000 * k for k in range(1, 41)]
    known = {p: encoder.encode(p) for p in words.dictionary.to_pylist()}
    assert encoder.encode_all(texts) == [b"".join([known[p] for p in t.split()]) for t in texts]


def test_memory_of_a_batch_is_bounded(encoder):
    texts = ["word " * 200_000] * 8
    tracemalloc.start()
    ids = encoder.encode_all(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) == 8 and all(len(x) == 800_000 for x in ids)
    assert peak < 48 << 20, peak


def test_signs_and_marks_in_one_batch(encoder):
    texts = [",,, a", "end.", "x<|endoftext|>... b,", "ends... then, ,,a, <| c. ", None, "", "*", "a... \n\n.", "Ça, là!! ÿ."] * 2
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts)] == [plain(encoder, t) for t in texts]
    letters = ["".join(map(chr, range(0xDF, 0x100))).replace("÷", " ÷ "), *(f"a{chr(c)} {chr(c)}z" for c in range(0xC0, 0x100))]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(letters)] == [plain(encoder, t) for t in letters]


def test_ids_that_do_not_fit_are_refused():
    ids = np.array([1, 65_535], "<u4").tobytes()
    assert tokenfile._wide(tokenfile._narrow(ids, 2), 2) == ids
    with pytest.raises(ValueError, match="65536"):
        tokenfile._narrow(np.array([65_536], "<u4").tobytes(), 2)


def test_token_file(spark, docs_of, encoder, tmp_path):
    texts = TEXTS + [f"short text number {i}" for i in range(200)]
    docs = docs_of([(i, t) for i, t in enumerate(texts)]).union(docs_of([(7, "again"), (None, "no id")])).withColumn("ids", F.lit(1)).withColumn("part", F.lit(2))
    folder = tokenfile.write_tokens(docs, str(tmp_path / "f"), block_bytes=2000)
    rows = tokenfile.read_tokens(spark, folder).collect()
    assert len(rows) == len(texts) + 2
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, *sorted([*range(len(texts)), 7])]
    at = 0
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and ids[-1] == 2
        at += len(ids)
        if r.doc_id is not None and r.doc_id != 7:
            assert ids[:-1] == plain(encoder, texts[r.doc_id])
    some = tokenfile.read_tokens(spark, folder, [3, 150]).collect()
    assert sorted((r.doc_id, r.start) for r in some) == sorted((r.doc_id, r.start) for r in rows if r.doc_id in (3, 150))
    assert tokenfile.read_tokens(spark, folder, []).count() == 0
    assert spark.read.parquet(f"{folder}/dictionary").first().hash != ""


def test_token_file_without_rows_or_dictionary(spark, docs_of, tmp_path):
    empty = tokenfile.write_tokens(docs_of(["a"]).where("false"), str(tmp_path / "e"))
    assert tokenfile.read_tokens(spark, empty).count() == 0
    few = tokenfile.write_tokens(docs_of(["a", None]), str(tmp_path / "g"))
    assert [r.n_tokens for r in tokenfile.read_tokens(spark, few).orderBy("doc_id").collect()] == [2, 1]


def test_wrong_dictionary_is_refused(spark, docs_of, tmp_path):
    folder = tokenfile.write_tokens(docs_of([f"text {i}" for i in range(60)]), str(tmp_path / "h"))
    spark.createDataFrame([("0" * 64, 2, 2, bytearray(b"other"))], "hash string, width int, end_id int, dictionary binary").write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(ValueError):
        tokenfile.read_tokens(spark, folder)


def test_token_file_query(spark, sf_dir, encoder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sorted(tokenfile.op6_token_file(spark, sf_dir).collect(), key=lambda r: r.doc_id)
    at = 0
    for r in rows:
        ids = np.array([*plain(encoder, docs[r.doc_id]), 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(rows) == len(docs)


def check_pack(lengths, window):
    p = packing.pack(np.array(lengths, np.int64), window)
    covered = {d: np.zeros(n, int) for d, n in enumerate(lengths)}
    for d, s, n, _, _ in p.tolist():
        assert n > 0
        covered[d][s : s + n] += 1
    assert all((c == 1).all() for c in covered.values())
    for k in set(p[:, 3].tolist()):
        rows = sorted(p[p[:, 3] == k].tolist(), key=lambda r: r[4])
        at = 0
        for _, _, n, _, o in rows:
            assert o == at
            at += n
        assert at == window or at & (at - 1) == 0
        assert at <= window
    return p


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=60))
def test_packing_any_lengths(lengths):
    check_pack(lengths, 64)


def test_packing_cuts_once_a_sequence():
    rng = random.Random(1)
    lengths = [rng.randint(1, 2000) for _ in range(4000)]
    p = check_pack(lengths, 2048)
    assert len(p) <= len(lengths) + p[:, 3].max() + 12  # a cut for each sequence at most
    check_pack([500] * 1000, 2048)
    check_pack([2048, 4096, 1], 2048)


def test_nnls():
    rng = np.random.default_rng(0)
    a = rng.random((6, 10))
    x = packing.nnls(a, a @ np.array([0, 2, 0, 0, 1, 0, 0, 3, 0, 0.0]))
    assert (x >= 0).all() and np.allclose(a @ x, a @ np.array([0, 2, 0, 0, 1, 0, 0, 3, 0, 0.0]), atol=1e-6)
    slope = a.T @ (np.ones(6) - a @ (y := packing.nnls(a, np.ones(6))))
    assert (slope <= 1e-6).all() and np.allclose(slope[y > 0], 0, atol=1e-6)


def check_rows(rows, docs, encoder):
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(docs)
    for i, pieces in by_doc.items():
        ids = np.array([*plain(encoder, docs[i]), 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    by_seq: dict = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_packed(docs_of, encoder):
    docs = docs_of(TEXTS).withColumn("start", F.lit(0)).withColumn("length", F.lit(0))
    for chunk in (4_000_000, 500):
        check_rows(packing.packed(docs, chunk_tokens=chunk).collect(), dict(enumerate(TEXTS)), encoder)
    assert packing.packed(docs_of(["a"]).where("false")).count() == 0
    twice = packing.packed(docs_of([(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert sum(r.length for r in twice) == 8 and any(r.doc_id is None for r in twice)


def test_packing_query(spark, sf_dir, encoder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_rows(packing.op9_packing(spark, sf_dir).collect(), docs, encoder)
