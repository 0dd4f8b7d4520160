import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom.operators import counts, evaluate
from corpusloom.operators.bpe import codec, dictionary, distributed
from corpusloom.operators.bpe.checkpoint import Checkpoint
from corpusloom.operators.bpe.chain import Chain, Ranks, apply_ranks
from corpusloom.operators.bpe.learner import Counted, Flat, Located, learn, learn_by_recount, replaced
from corpusloom.operators.bpe.model import ALPHABET, OFFSET, Model, Symbols

UNITS = st.lists(st.tuples(st.lists(st.integers(0, 4), max_size=9).map(tuple), st.integers(1, 4)), min_size=1, max_size=6)
WORDS = {"aaaaaa": 3, "abab": 2, "bbb": 2, "a b a": 4, "aa": 1}
SMALL = {"shortlist": 2, "sample": 4, "rewrite": 3}


def coded(words):
    s = Symbols()
    return [([s.id_of(c) for c in w], n) for w, n in words.items()]


def test_golden_words():
    s = Symbols()
    merges, seqs = learn(coded({"low": 5, "lower": 2, "newest": 6, "widest": 3}), 101, s)
    assert merges == [(69, 83, 95), (95, 84, 96), (76, 79, 97), (97, 87, 98), (69, 87, 99), (78, 99, 100)]
    assert ["|".join(s.strings[i] for i in x) for x in seqs] == ["low", "low|e|r", "new|est", "w|i|d|est"]


def test_golden_self_pairs():
    assert learn(coded({"aaaa": 1}), 120, Symbols())[0] == [(65, 65, 95), (95, 95, 96)]
    assert learn(coded({"aaa": 1}), 120, Symbols())[0] == [(65, 65, 95), (95, 65, 96)]


def two_stage(spark, **more):
    lines = spark.createDataFrame([("to be or not to be",), ("to be is to do",)], "text string")
    return distributed.train(lines, 4, 4, more=True, **more)


@pytest.mark.parametrize("dealt", [None, SMALL])
def test_golden_two_stages(spark, dealt):
    m = two_stage(spark, dealt=dealt)
    assert m.stage1 == [(84, 79, 95), (66, 69, 96), (68, 79, 97), (73, 83, 98)]
    assert m.stage2 == [(95, 0, 99), (99, 96, 100), (100, 0, 101), (0, 78, 102)]
    c = codec.Codec(m)
    assert [c.string(i) for i in c.encode("to be or not to be")] == ["to be ", "o", "r", " n", "o", "t", " ", "to be"]
    assert [c.string(i) for i in c.encode("to be is to do")] == ["to be ", "is", " ", "to ", "do"]


@settings(max_examples=300, deadline=None)
@given(UNITS, st.sampled_from([None, 1, 2]))
def test_learner_equals_recount(units, span):
    assert learn(units, 107, Symbols(), max_span_words=span)[0] == learn_by_recount(units, 107, Symbols(), span)


@pytest.mark.parametrize("dealt", [SMALL, {"shortlist": 1, "sample": 1000}, {}])
@pytest.mark.parametrize("span", [None, 1, 2])
def test_distributed_with_cap_on_self_pairs(spark, span, dealt):
    units = spark.createDataFrame(list(WORDS.items()), "unit string, freq long")
    want = learn_by_recount(coded(WORDS), 107, Symbols(), span)
    assert distributed.learn_units(units, 12, Symbols(), more=True, max_span_words=span, dealt=dealt) == want


@pytest.mark.parametrize("dealt", [{"shortlist": 12, "sample": 300, "rewrite": 16}, {"shortlist": 40}])
@pytest.mark.parametrize("span", [None, 2])
def test_distributed_equals_recount_on_lines(spark, monkeypatch, dealt, span):
    """Lists that are cut off and run out, proposals that fail, several chunks in a task."""
    monkeypatch.setattr(distributed, "CHUNK", 700)
    r = random.Random(5)
    words = ["".join(r.choices("abcde", k=r.randint(1, 5))) for _ in range(40)]
    lines = Counter(" ".join(r.choices(words, weights=range(40, 0, -1), k=r.randint(1, 12))) for _ in range(250))
    units = spark.createDataFrame(list(lines.items()), "unit string, freq long").repartition(3)
    want = learn_by_recount(coded(lines), 95 + 70, Symbols(), span)
    assert distributed.learn_units(units, 70, Symbols(), more=True, max_span_words=span, dealt=dealt) == want


def test_proposals_of_all_units_are_taken_in_one_pass(spark):
    r = random.Random(1)
    words = Counter("".join(r.choices("abcdefgh", weights=range(8, 0, -1), k=r.randint(2, 9))) for _ in range(3000))
    units = spark.createDataFrame(list(words.items()), "unit string, freq long")
    s = Symbols()
    for c in distributed.characters(units):
        s.id_of(c)
    corpus = distributed.DealtCorpus(units.select(distributed.as_symbols(F.col("unit"), s.base).alias("unit"), "freq"))
    merges, _ = learn(lambda done: corpus, 95 + 100, s)
    assert merges == learn_by_recount(coded(words), 195, Symbols()) and corpus.passes == 1 and corpus.floor == 0


@pytest.mark.parametrize("shortlist", [3, 1 << 16])
def test_distributed_pmi(spark, shortlist):
    """A list by PMI that is cut off goes on where it ends, by the scores of its time."""
    r = random.Random(2)
    words = Counter("".join(r.choices("abcdef", weights=(9, 7, 5, 3, 2, 1), k=r.randint(2, 7))) for _ in range(400))
    units = spark.createDataFrame(list(words.items()), "unit string, freq long")
    how = {"criterion": "pmi", "pmi_min_count": 4, "pmi_rebuild_every": 8}
    want, _ = learn(coded(words), 95 + 25, Symbols(), **how)
    assert distributed.learn_units(units, 25, Symbols(), more=True, dealt={"shortlist": shortlist}, **how) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 30), st.integers(1, 50), max_size=20), max_size=6), st.integers(1, 8))
def test_summaries_bound_what_they_miss(parts, most):
    total: Counter = Counter()
    s = distributed.Summary(most)
    for p in parts:
        total.update(p)
        keys = np.array(sorted(p), np.int64)
        s.add(keys, np.array([p[k] for k in keys.tolist()], np.int64))
    listed = dict(zip(s.keys.tolist(), s.n.tolist(), strict=True))
    assert len(listed) <= most
    assert all(listed.get(k, 0) <= n <= listed.get(k, 0) + s.missed for k, n in total.items())


def test_span_cap_ends(spark):
    assert learn(coded({"a b": 5}), 200, Symbols(), max_span_words=1)[0] == []


def test_pmi_rules():
    units = coded({"abab": 10, "cd": 5, "ce": 5, "xy": 4})
    merges, _ = learn(units, 97, Symbols(), criterion="pmi", pmi_min_count=5)
    assert merges[0] == (65, 66, 95) or merges[0] == (67, 68, 95)
    assert all({a, b} != {88, 89} for a, b, _ in learn(units, 110, Symbols(), criterion="pmi", pmi_min_count=5)[0])
    frozen = learn(coded({"abc": 9, "ab": 9}), 110, Symbols(), criterion="pmi", pmi_min_count=1, pmi_rebuild_every=300)[0]
    assert frozen[-1][2] == 94 + len(frozen)


@settings(max_examples=300, deadline=None)
@given(UNITS, st.lists(st.integers(0, 4), max_size=120))
def test_encoding_equals_replacing_in_order(units, seq):
    merges, _ = learn(units, 110, Symbols())
    want = list(seq)
    for a, b, new in merges:
        want = replaced(want, a, b, new)
    assert codec.apply_merges(seq, {(a, b): (r, n) for r, (a, b, n) in enumerate(merges)}) == want


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_round_trip_of_any_text(text):
    s = Symbols()
    first, seqs = learn(coded({"low": 5, "lower": 2}), 99, s)
    second, _ = learn([([76, 79, 0, 76, 79], 3)], 103, s)
    m = Model(s.strings, first, second)
    assert codec.Codec(m).decode(codec.Codec(m).encode(text)) == text


def test_columns(spark, tmp_path):
    m = two_stage(spark)
    texts = [*evaluate.ADVERSARIAL, None, "to be é to be"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    back = codec.decode(codec.encode(df, m), m).orderBy("i").collect()
    assert [r.decoded for r in back] == texts
    assert all(evaluate.validate(m).values())
    m.save(str(tmp_path / "m.json"))
    assert Model.load(str(tmp_path / "m.json")) == m
    plain = df.where(F.col("text").rlike("^[ -~]*$"))
    native = {r.i: r.n for r in plain.select("i", codec.encode_native(F.col("text"), m).alias("n")).collect()}
    assert native == {r.i: r.ids for r in back if r.i in native}
    with pytest.raises(ValueError):
        codec.Codec(m).string(len(m.strings))
    vocab, merges = m.tables(spark)
    assert vocab.count() == len(m.strings) and merges.count() == len(m.merges)


def test_baseline_codec(spark):
    df = spark.createDataFrame([("ab",), ("",), ("é😀",)], "t string").select("t", codec.encode_baseline(F.col("t")).alias("ids"))
    rows = df.select("t", "ids", codec.decode_baseline(F.col("ids")).alias("back")).collect()
    assert rows[0].ids == [98, 99, 0] and all(r.t == r.back for r in rows)


@settings(max_examples=300, deadline=None)
@given(UNITS, st.integers(0, 12))
def test_chain_equals_replacing_and_snapshots(units, cut):
    merges, seqs = learn(units, 107, Symbols())
    half = [list(u) for u, _ in units]
    for m in merges[:cut]:
        half = [replaced(q, *m) for q in half]
    chain = Chain(np.array([x for u, _ in units for x in u], np.int32), np.array([len(u) for u, _ in units]))
    at_cut, end = apply_ranks(chain, Ranks(merges), [min(cut, len(merges))])
    assert at_cut.tolist() == list(map(len, half)) and end.tolist() == list(map(len, seqs)) and chain.seqs() == seqs
    assert learn(units, 107, Symbols(), done=merges[:cut]) == (merges, seqs)


def pmi_by_recount(units, target, symbols, least, rebuild):
    """The PMI rule with everything counted anew."""
    seqs, merges, listing, since = [(list(s), f) for s, f in units], [], None, 0
    while len(symbols) < target:
        n, one = Counter(), Counter()
        for s, f in seqs:
            for x in s:
                one[x] += f
            for p in zip(s, s[1:], strict=False):
                n[p] += f
        score = {p: math.log(k) - math.log(one[p[0]]) - math.log(one[p[1]]) for p, k in n.items() if k >= least}
        if listing is None or since >= rebuild:
            listing, since, fresh = dict(score), 0, True
        while listing and (best := min(listing, key=lambda p: (-listing[p], p))) is not None and abs(score.get(best, -math.inf) - listing[best]) > 1e-9:
            del listing[best]
        if not listing:
            if fresh:
                break
            listing = None
            continue
        del listing[best]
        new = symbols.merged(*best)
        merges.append((*best, new))
        seqs = [(replaced(s, *best, new), f) for s, f in seqs]
        since, fresh = since + 1, False
    return merges


@settings(max_examples=200, deadline=None)
@given(UNITS, st.sampled_from([1, 3, 300]), st.sampled_from([1, 3]))
def test_pmi_equals_recount(units, rebuild, least):
    got = learn(units, 107, Symbols(), criterion="pmi", pmi_min_count=least, pmi_rebuild_every=rebuild)[0]
    assert got == pmi_by_recount(units, 107, Symbols(), least, rebuild)


def test_dealt_units_learn_the_same(spark, tmp_path, monkeypatch):
    """By both criteria, resumed, and with arrays that are rewritten on the way."""
    rng = random.Random(8)
    words = {"".join(rng.choices("abcde ", k=rng.randint(1, 9))): rng.randint(1, 30) for _ in range(200)}
    units = spark.createDataFrame(list(words.items()), "unit string, freq long").repartition(3)
    monkeypatch.setattr(distributed, "CHUNK", 200)
    for how in ({}, {"criterion": "pmi", "pmi_min_count": 3, "pmi_rebuild_every": 4}):
        want, _ = learn(coded(words), 95 + 14, Symbols(), **how)
        assert distributed.learn_units(units, 14, Symbols(), more=True, dealt={"rewrite": 5, "sample": 100}, **how) == want
        mark = Checkpoint(str(tmp_path / f"{len(how)}.json"), 3)
        if not how:  # PMI lists its candidates again on resuming
            distributed.learn_units(units, 7, Symbols(), checkpoint=mark, more=True, **how)
        assert distributed.learn_units(units, 14, Symbols(), checkpoint=mark, more=True, **how) == want
        monkeypatch.setattr(distributed, "DealtCorpus", None)
        assert distributed.learn_units(units, 14, Symbols(), checkpoint=mark, more=True, **how) == want  # complete: units are not read
        monkeypatch.undo()
        monkeypatch.setattr(distributed, "CHUNK", 200)


def test_progress_is_logged(caplog):
    with caplog.at_level("INFO"):
        learn(coded({"abcdefgh": 3}), 100, Symbols(), report_every=2)
    assert [r.args[0] for r in caplog.records] == [2, 4]


def test_documents_in_a_store(spark, tmp_path):
    path = f"file://{tmp_path}/m.json"
    m = two_stage(spark)
    for _ in range(2):
        m.save(path)
    assert Model.load(path) == m and Checkpoint(f"file://{tmp_path}/none.json").load() is None


def test_resume_equals_uninterrupted(tmp_path):
    words = {"".join(random.Random(i).choices("abcd", k=6)): i % 5 + 1 for i in range(40)}
    whole = learn(coded(words), 125, Symbols())[0]
    c = Checkpoint(str(tmp_path / "c.json"), every=3)
    c.run(coded(words), 105, Symbols(), "x")
    assert c.run(coded(words), 125, Symbols(), "x") == whole
    with pytest.raises(ValueError):
        c.run(coded(words), 125, Symbols(), "y")
    assert Model(["x"] * 125, whole, []).at(105).stage1 == whole[:10]


def test_counts(spark):
    units = spark.createDataFrame([("aaa", 2), ("ab", 1), ("", 4)], "unit string, freq long")
    assert {(r.a, r.b): r.n for r in counts.pair_counts(units).collect()} == {("a", "a"): 4, ("a", "b"): 1}
    assert {r.symbol: r.n for r in counts.symbol_counts(units).collect()} == {"a": 7, "b": 1}
    assert counts.fingerprint(units).first().fingerprint == "3:7:8"
    other = spark.createDataFrame([("aab", 2), ("ab", 1), ("", 4)], "unit string, freq long")
    assert counts.fingerprint(units).first().content != counts.fingerprint(other).first().content


def test_alphabet():
    assert len(ALPHABET) == 95 and ALPHABET[0] == " " and Symbols().id_of("~") == 94


def test_reports(spark):
    m = two_stage(spark)
    lines = spark.createDataFrame([("a", 0, 0, "to be"), ("a", 0, 1, "x y"), ("b", 1, 0, "zz")], "lang string, doc_id long, line_no int, text string")
    stats = evaluate.token_stats(lines, m)
    by = {r.lang: r for r in evaluate.compression(stats).collect()}
    assert (by["a"].tokens, by["a"].chars, by["a"].crossing) == (4, 8, 2) and by[None].tokens == 6
    blob = {r.lang: r for r in evaluate.compression(stats, "blob").collect()}
    assert (blob["a"].tokens, blob["a"].chars) == (5, 9)
    assert {r.lang: r.chars for r in evaluate.compression(stats, "words").collect()}["a"] == 9
    assert evaluate.worst_language(evaluate.compression(stats)).first().lang == "b"
    assert evaluate.crossing_ids(m, strict=True) and 0 not in evaluate.crossing_ids(m, strict=True)
    assert evaluate.round_trip(lines, m).first().n_mismatch == 0
    sweep = {(r.config, r.lang): r.value for r in evaluate.sweep(lines, {"a": m, "b": m.at(97)}, "a", "line").collect()}
    half = {r.lang: r.tokens_per_char for r in evaluate.compression(evaluate.token_stats(lines, m.at(97))).collect()}
    assert sweep["b", "BLENDED"] == half[None] and sweep["b", "a"] == half["a"] and sweep["a", "b"] == 1.0
    curve = evaluate.training_curve(lines, lines.where("lang = 'a'"), m, [97, len(m.strings)])
    points = evaluate.curve_document(curve)
    assert [(p["stage"], p["vocab_size"]) for p in points] == [(1, 97), (2, len(m.strings))]
    assert points[0]["train_tokens_per_char"] == half[None] and points[0]["heldout_per_lang"] == {"a": half["a"]} and points[0]["train_per_lang"]["b"] == 1.0
    assert evaluate.sweep_document(evaluate.sweep(lines, {"a": m}, "a"))["blended"].keys() == {"a"}
    assert evaluate.available(["c", "b", "a"], lines) == ["b", "a"]
    assert evaluate.tokenised("to be to", {"m": m}) == {"m": (2, ["to be ", "to"])}
    assert [(r.lang, r.same) for r in evaluate.spot_check(lines, m, 1).orderBy("lang").collect()] == [("a", True), ("b", True)]
    assert evaluate.validate(m, lines=lines)["passed"] and not evaluate.validate(m, 50)["passed"]
    assert evaluate.throughput(spark, lines, m)["status"] in ("OK", "TIGHT", "FAIL")


@settings(max_examples=200, deadline=None)
@given(UNITS, UNITS, st.lists(st.one_of(st.none(), st.text("abcde zé\n", max_size=30)), max_size=6), st.integers(0, 3))
def test_batches_by_words_equal_merges_by_rank(first, second, texts, most):
    """Words encoded once, forgotten and met again, give what merging the lowest rank again and again gives."""
    s = Symbols()
    for c in "abcde":
        s.id_of(c)
    one, _ = learn([(tuple(s.base["abcde"[x]] for x in u), f) for u, f in first], 104, s)
    ranks = {(a, b): (r, n) for r, (a, b, n) in enumerate(one)}
    two, _ = learn([(tuple(codec.apply_merges([*[s.base["abcde"[x]] for x in u], 0] * 2, ranks)), f) for u, f in second], 112, s)
    m = Model(s.strings, one, two)
    batch = codec.BatchCodec(m)
    batch.words.most = most
    ranks = {(a, b): (r, n) for r, (a, b, n) in enumerate(m.merges)}
    want = [codec.apply_merges([codec.Codec(m).char(c) for c in t or ""], ranks) for t in texts]
    for _ in range(2):
        flat, at = batch.lists(pa.array(texts, pa.string()))
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_words_are_encoded_once(monkeypatch):
    m = Model([*ALPHABET, "ab"], [(65, 66, 95)], [])
    batch = codec.BatchCodec(m)
    for _ in range(3):
        batch.lists(pa.array(["ab ab cd", "cd", None, "", "x  ab"]))
    assert batch.words.encoded == 4  # ab, cd, x and the empty word


def test_stage_1_with_spaces_is_encoded_whole():
    m = Model([*ALPHABET, "a "], [(65, 0, 95)], [])
    batch = codec.BatchCodec(m)
    assert batch.words is None and batch.lists(pa.array(["a b"]))[0].tolist() == [95, 66]


def test_batches_are_cut_by_characters(monkeypatch):
    monkeypatch.setattr(codec, "TOGETHER", 5)
    b = pa.RecordBatch.from_arrays([pa.array(["abc", "de", "f", None, "much longer than that", "", "x"])], names=["t"])
    assert [p.column(0).to_pylist() for p in codec.parts_of([b], "t")] == [["abc", "de"], ["f", None], ["much longer than that"], ["", "x"]]


@settings(max_examples=300, deadline=None)
@given(UNITS, st.lists(st.lists(st.integers(0, 4), max_size=40), max_size=5), st.lists(st.integers(0, 16), max_size=3))
def test_blocks_equal_merges_by_rank(units, seqs, stops):
    """Merges of a block together, and the states in front of some ranks."""
    merges, _ = learn(units, 110, Symbols())
    chain = Chain(np.array([x for q in seqs for x in q], np.int32), np.array([len(q) for q in seqs], np.int64))
    states = list(apply_ranks(chain, Ranks(merges), stops))
    rank = lambda most: {(a, b): (r, n) for r, (a, b, n) in enumerate(merges[:most])}
    assert chain.seqs() == [codec.apply_merges(q, rank(None)) for q in seqs]
    assert [list(x) for x in states] == [[len(codec.apply_merges(q, rank(k))) for q in seqs] for k in [*sorted(stops), None]]


def test_long_runs_take_few_steps():
    merges = [(65, 65, 95), (95, 95, 96), (65, 66, 97)]
    chain = Chain(np.array([65] * 5001 + [66], np.int32), np.array([5002]))
    list(apply_ranks(chain, Ranks(merges)))
    assert chain.seqs() == [[96] * 1250 + [97]]


def test_lines_by_a_table_of_words(spark, monkeypatch):
    lines = ["to be or not to be", "  to  be ", "", "be", None, " ", "das da zu"]
    units = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "unit string, freq int")
    m = two_stage(spark)
    first = codec.Codec(Model(m.strings, m.stage1, []))
    for frequent in (1, 256, 10**6):  # all words by shuffle, some, and all by broadcast
        monkeypatch.setattr(dictionary, "FREQUENT", frequent)
        got = {r.freq: r.ids for r in dictionary.encode_by_words(units, m).collect()}
        assert [[ord(c) - OFFSET for c in got[i] or ""] for i in range(len(lines))] == [first.encode(x or "") for x in lines]
        assert got[4] is None
    table = dictionary.word_table(units.where("unit IS NOT NULL"), m)
    assert table.count() == table.select("word").distinct().count() == 7
    with pytest.raises(Exception, match="lacks the word"):
        dictionary.encode_by_words(units, m, table.where("word <> 'das'")).collect()


def test_chunks_of_a_batch_are_held_one_at_a_time():
    """A batch of a hundred chunks takes the memory of a few; before, all were copied out of it."""
    n, k = 1 << 16, 100
    rows = [distributed._packed(Chain(np.arange(n) % 90, np.array([n])), np.array([1])) for _ in range(k)]
    batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    tracemalloc.start()
    try:
        assert sum(int(c.chain.counts().sum()) for c in distributed._unpacked(iter([batch]))) == n * k
        assert tracemalloc.get_traced_memory()[1] < 2 * n * k
    finally:
        tracemalloc.stop()


@settings(max_examples=100, deadline=None)
@given(UNITS, st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=6))
def test_pairs_by_a_table_equal_sorted_ones(units, pairs):
    """Ranks and counts of pairs, and where they stand: by a table or looked for one by one, and by sorting."""
    seqs, freqs = zip(*units, strict=True)
    fresh = lambda: Counted(Chain(np.array([x for s in seqs for x in s], np.int32), np.array([len(s) for s in seqs])), np.array(freqs))
    keys, n, _, _ = fresh().pairs()
    assert [x.tolist() for x in fresh().pair_counts()] == [keys.tolist(), n.tolist()]
    merges = [(a, b, 7 + i) for i, (a, b) in enumerate(pairs)]
    ranks, sorted_ = Ranks(merges), Ranks(merges)
    sorted_.table = None
    a, b = (np.array(x, np.int32) for x in zip(*[(x, y) for x in (-2, -1, 0, 3, 5, 6, 1_000_000) for y in (-2, -1, 0, 4, 5, 6, 1_000_000)], strict=True))
    assert ranks.of(a, b).tolist() == sorted_.of(a, b).tolist()
    ways = [Located(fresh()), Located(fresh(), lazily=True), Located(fresh(), np.unique(np.array([a << 32 | b for a, b in pairs])))]
    for m in merges:
        assert len({tuple(map(str, (k.tolist(), d.tolist(), t))) for k, d, t in (w.merge(*m) for w in ways)}) == 1


def test_configurations_share_what_their_first_stages_know():
    """One memory of words for models with the same first stage, and none of their texts is put together where all merges are inside words."""
    s = Symbols()
    first, _ = learn(coded({"low": 5, "lower": 2, "newest": 6}), 99, s)
    both = Model(list(s.strings), first, [])
    second = [(0, s.base["l"], s.merged(0, s.base["l"]))]
    both = Model(s.strings, first, second)
    a, b, c = codec.sharing([codec.BatchCodec(m) for m in (both, Model(both.strings, first, []), both.at(97))])
    texts = pa.array(["lower newest", "", None, " low  low ", "\u2603 low"])
    assert a.words is b.words is not c.words and a.counts(texts) is None
    for x in (b, c):
        tokens, spaces = x.counts(texts, codec.Words.split(texts))
        ids, at = x.lists(texts)
        assert tokens.tolist() == np.diff(at).tolist() and spaces.dtype == np.int64
        assert spaces.tolist() == [ids[i:j].tolist().count(0) for i, j in zip(at[:-1], at[1:], strict=True)] == [1, 0, 0, 4, 1]
    assert a.lists(texts)[0].tolist() == [i for t in texts.to_pylist() for i in codec.Codec(both).encode(t or "")]


def test_few_merges_are_made_in_whole_texts():
    """Up to a number of merges no word is looked up or remembered, with the same ids."""
    m = Model([*ALPHABET, "ab", " ab", "ab ab"], [(65, 66, 95)], [(0, 95, 96), (95, 96, 97)])
    texts = pa.array(["ab ab ab cd", "cd", None, "", "x  ab\u2603"])
    words, whole = codec.BatchCodec(m, 2), codec.BatchCodec(m, 3)
    assert words.words is not None and whole.words is None
    assert [x.tolist() for x in words.lists(texts)] == [x.tolist() for x in whole.lists(texts)]


def test_code_points_come_out_of_the_bytes():
    texts = pa.array(["xx", "ab", None, "", "z\u00e9\u2603\U00010348", "b"])
    assert codec.codes(texts.slice(1, 4)).tolist() == [97, 98, 122, 0xE9, 0x2603, 0x10348]
    assert codec.codes(texts.slice(0, 4)).tolist() == [120, 120, 97, 98] and not len(codec.codes(texts.slice(2, 2)))


def test_units_are_learned_without_being_translated(spark, monkeypatch):
    """Tasks take symbols from plain units, and characters beyond the alphabet are known by their codes."""
    monkeypatch.setattr(distributed, "as_symbols", lambda *_: 1 / 0)
    units = {"na\u00efve": 7, "na\u00efves": 2, "\u2603\u00ef": 3, "nana": 1}
    df, s, t = spark.createDataFrame(list(units.items()), "unit string, freq long"), Symbols(), Symbols()
    assert distributed.characters(df) == sorted(set("".join(units)))
    got = distributed.learn_units(df, 6, s, more=True)
    for c in sorted(set("".join(units))):
        t.id_of(c)
    assert got == learn([([t.base[c] for c in u], f) for u, f in units.items()], len(t) + 6, t)[0] and s.strings == t.strings


def test_lists_of_ids_are_joined_at_once():
    """As one after another, cut where there are many ids; what is no id is an error."""
    m = Model([*ALPHABET, "ab"], [(65, 66, 95)], [])
    ids = pa.array([[95, 0], None, [], [m.escape + 0x2603, 1, m.escape + 0x2603], [95]], pa.list_(pa.int32()))
    for together in (1, 2, 100):
        assert codec.Strings(m).joined(ids, together).to_pylist() == ["ab ", None, "", "\u2603!\u2603", "ab"]
    assert codec.Strings(m).joined(ids.slice(3, 1)).to_pylist() == ["\u2603!\u2603"] and not len(codec.Strings(m).joined(ids[:0]))
    for bad in (-1, 96, m.escape - 1, m.escape + 0x110000, None):
        with pytest.raises(ValueError, match="is no id of this vocabulary"):
            codec.Strings(m).joined(pa.array([[1, bad]], pa.list_(pa.int32())))


def test_token_counts_encode_texts_together(spark, monkeypatch):
    """A partition of fewer than TOGETHER characters is encoded once, however many texts it has."""
    from corpusloom.functions import register as module

    seen, kept = [], {}
    monkeypatch.setattr(type(spark.udtf), "register", lambda self, name, f: kept.setdefault(name, f))
    module.register(spark, Model([*ALPHABET, "ab"], [(65, 66, 95)], []))
    counts = kept["bpe_token_counts"].func()
    lists = counts.codec.lists
    counts.codec.lists = lambda texts: seen.append(len(texts)) or lists(texts)
    for k in range(3000):
        counts.eval(Row(lang="x", text="ab" * 100 + str(k % 10)), "text")
    assert list(counts.terminate()) == [("x", 16 + k, str(k), 300) for k in range(10)] + [("x", 95, "ab", 300000)] and seen == [3000]


def test_words_are_counted_by_line(spark):
    """As rows of single words would be: white space is characters and no tokens."""
    m = Model([*ALPHABET, "ab"], [(65, 66, 95)], [])
    lines = spark.createDataFrame([("x", "ab  ab c"), ("x", " "), ("x", "ab\u2603"), (None, "c ")], "lang string, text string")
    one = lambda stats: sorted(map(str, evaluate.compression(stats, "words").select("lang", "total", "tokens", "chars", "crossing").collect()))
    words = lines.select("lang", F.explode(F.split("text", " ")).alias("text"))
    assert one(evaluate.word_stats(lines, m))[:2] == one(evaluate.token_stats(words, m))[:2]
    assert evaluate.word_stats(lines, m).agg(F.sum("tokens"), F.sum("crossing")).first()[:] == (6, 0)


def test_baseline_codec_takes_one_byte_characters_without_a_decoder(spark):
    texts = ["", "a\x00b", "\x7f\x80\xff\u0100", "\u2603\U0010ffff \n", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("text", codec.encode_baseline(F.col("text")).alias("ids"), "i").withColumn("back", codec.decode_baseline(F.col("ids"))).orderBy("i")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    for r in rows.collect():
        assert (r.ids, r.back) == (None if r.text is None else [*(ord(c) + 1 for c in r.text), 0], r.text)
    assert "filter(" not in plan and "chr(" in plan


@pytest.mark.parametrize("block", [12, 1 << 21])
def test_words_travel_once_for_a_block_of_lines(spark, monkeypatch, block):
    """Before, each place of a word was a row of its own, shuffled by word and again by line."""
    monkeypatch.setattr(dictionary, "BLOCK", block)
    seen, cut = [], dictionary.cut
    monkeypatch.setattr(dictionary, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    lines = [*["to be or not to be"] * 50, "  to  be ", "", None, "  ", "na\u00efve \u2603", "be"]
    units = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "unit string, freq int").repartition(2)
    m = two_stage(spark)
    first = codec.Codec(Model(m.strings, m.stage1, []))
    got = {r.freq: r.ids for r in dictionary.encode_by_words(units, m, as_chars=False).collect()}
    assert [got[i] for i in range(len(lines))] == [x if x is None else first.encode(x) for x in lines]
    words = next(df for df in seen if df.columns == ["block", "word", "n"])
    assert words.count() == words.select("block", "word").distinct().count()
    assert {r.word: r.n for r in words.groupBy("word").agg(F.sum("n").alias("n")).collect()} == Counter(w for x in lines for w in (x or "").split(" ") if w)
    assert block == 12 or words.count() < 2 * 7


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(-1, 3), st.integers(-3, 3)), max_size=8), min_size=1, max_size=4))
def test_changes_of_a_task_are_summed(parts):
    """Each step's key is one row of a task and not one of each chunk."""
    got = distributed._summed([tuple(np.array([r[i] for r in p], np.int64) for i in range(3)) for p in parts])
    want: Counter = Counter()
    for step, key, n in (r for p in parts for r in p):
        want[step, key] += n
    assert {(s, k): n for s, k, n in zip(*(x.tolist() for x in got), strict=True)} == dict(want)
    assert len(got[0]) == len(want)


def test_a_pass_takes_little_memory_beside_its_batch():
    """Chunks are a quarter as long as before: a full one with its merges took over 60 MB."""
    n, lines = distributed.CHUNK, 800
    ids = np.random.default_rng(7).integers(0, 90, n).astype(np.uint16)
    row = distributed._row(ids, np.full(lines, n // lines) + (np.arange(lines) < n % lines), np.ones(lines, np.int64))
    tracemalloc.start()
    try:
        (c,) = distributed._unpacked(iter([row]))
        here = Located(c, lazily=True)
        for i in range(20):
            here.merge(i, i + 20, 90 + i)
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()


def test_characters_of_any_text_are_found(spark, monkeypatch):
    monkeypatch.setattr(distributed, "CHUNK", 4)
    units = ["aab", None, "ba", "\u00e9a", "", "c\u2603b\U00010348", "\x00d", "\u00e9\x7f"]
    df = spark.createDataFrame([(u,) for u in units], "unit string").coalesce(1)
    assert distributed.characters(df) == sorted(set("".join(u or "" for u in units)))


@settings(max_examples=100, deadline=None)
@given(UNITS, st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=6), st.integers(1, 40), st.booleans())
def test_merges_without_links_equal_those_with_links(units, pairs, together, one):
    """Changes of counts and weights are the same whether symbols have links or not, and however they are dealt out."""
    count = lambda us: Counted(Chain(np.array([x for s, _ in us for x in s], np.int32), np.array([len(s) for s, _ in us])), np.array([f for _, f in us]))
    dealt = lambda: iter([count(units)] if one else [count([u]) for u in units])
    flat, as_one, linked = Flat(dealt(), together), Located(distributed._as_one(dealt())), Located(count(units))
    seqs = [s for s, _ in units]
    for i, (a, b) in enumerate(pairs):
        got = []
        for way in (flat, as_one, linked):
            keys, n, total = way.merge(a, b, 9 + i)
            change: Counter = Counter()
            for k, d in zip(keys.tolist(), n.tolist(), strict=True):
                change[k] += d
            got.append(({k: d for k, d in change.items() if d}, total))
        assert got[0] == got[1]
        if max(a, b) < 9:  # an old pair is found by all
            assert got[0] == got[2]
        seqs = [replaced(s, a, b, 9 + i) for s in seqs]
    assert [x for s, _ in flat.parts for x in s[s >= 0].tolist()] == [x for s in seqs for x in s]


def test_proposals_take_few_bytes_a_symbol():
    """Few merges are proposed from symbols alone, some 5 bytes each with their frequencies; with links they took 35."""
    n, k = 1 << 18, 16
    ids = np.random.default_rng(7).integers(0, 90, n).astype(np.uint16)
    row = distributed._row(ids, np.full(n // 16, 16), np.ones(n // 16, np.int64))
    tracemalloc.start()
    try:
        here = Flat(distributed._unpacked(iter([row] * k)), n)
        for i in range(20):
            here.merge(i, i + 20, 90 + i)
        assert tracemalloc.get_traced_memory()[1] < 9 * n * k
    finally:
        tracemalloc.stop()


def test_the_sample_stays_in_chunks(spark, monkeypatch):
    """No task puts the sample together in one row; before, its one row had all of it."""
    monkeypatch.setattr(distributed, "CHUNK", 64)
    units = spark.createDataFrame([(f"word{i:04}", i + 1) for i in range(100)], "unit string, freq long")
    s = Symbols()
    corpus = distributed.DealtCorpus(units, texts=Model(list(s.strings), [], []))
    assert corpus.sample.rdd.getNumPartitions() == 1
    assert max(r.n for r in corpus.sample.select("n").collect()) <= 64
    want = learn_by_recount([(tuple(s.base[c] for c in f"word{i:04}"), i + 1) for i in range(100)], len(s) + 12, Symbols())
    assert learn(lambda _: corpus, len(s) + 12, s)[0] == want
