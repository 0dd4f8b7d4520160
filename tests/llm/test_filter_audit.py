from collections import Counter, defaultdict
from itertools import permutations

import pytest

from corpusloom.llm import filter_audit as fa

LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """Rows of the audit by walking every document through every order. docs are (doc_id, text, lang), labels (doc_id, quality, toxic)."""
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        rows.append((lang or "", fails, any(j == i and q == 1 for j, q, _ in labels if i is not None), any(j == i and x == 1 for j, _, x in labels if i is not None)))
    out, shap = {}, defaultdict(Counter)
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                failing = [r for r in mine if r[1][f]]
                shap[part][f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(sum(r[1].values()) == 1 for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return sorted((*k, *v, shap[k[0]][k[1][k[2] - 1]]) for k, v in out.items())


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LONG = " ".join(f"word{i}" for i in range(400))


def texts():
    cased = "X" + LONG[1:]
    return [
        (1, LONG, "en"), (2, LONG, "de"), (3, LONG + "$", "en"), (4, cased, "en"), (5, cased, None), (6, None, "en"), (7, "", ""), (8, "a a a a", "de"), (9, "a a a a", "de"), (10, "A B C D", "en"),
        (11, LONG[:-1] + "z", "en"), (12, "#" + LONG[1:], "de"), (13, "　" * 5, "en"), (None, LONG, "en"), (None, "lonely", "en"), (14, "x " * 30_000, "en"), (15, "x " * 30_000, "fr"), (2, LONG, "de"), (16, "x " * 29_999 + "y ", "fr"),
    ]


def test_against_every_order(spark):
    docs = texts()
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, None, 1), (9, 1, None), (99, 1, 1), (None, 1, 1), (15, 0, 1), (15, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "1 AS mask", "2 AS c0", "3 AS part")
    got = fa.interactions(fa.mask_counts(d, spark.createDataFrame(labels, LABELS)))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == plain(docs, labels)


def test_duplicates_are_judged_by_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(fa, "classes", lambda text, chars: [chars] * len(fa.KEYS))  # nothing but lengths tells classes apart
    docs = [(i, t, "en") for i, t in enumerate(["abc", "abd", "abc", "abcd", "abd", "xyz", None, ""])]
    found = fa.duplicates(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert sorted(r.doc_id for r in found.collect()) == [2, 4, 7]


def test_large_groups_and_full_bitmaps(spark, monkeypatch):
    docs = [(i, "same text" if i % 3 == 0 else f"text {i % 700}", "en") for i in range(3000)]
    small = fa.bitmap
    monkeypatch.setattr(fa, "bitmap", lambda keys: small(keys, 1 << 15))
    found = fa.duplicates(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    first = {}
    for i, t, _ in docs:
        first.setdefault(t, i)
    assert sorted(r.doc_id for r in found.collect()) == [i for i, t, _ in docs if first[t] != i]


def test_words_of_long_texts_come_in_pieces(monkeypatch):
    text = ("ab cd\tef gh " * 50).encode() + b"last"
    whole = fa.words(text)
    monkeypatch.setattr(fa, "_LONG", 7)
    assert fa.words(text) == whole == (201, 5)


@pytest.mark.parametrize("text", ["", "é" * 40, "a" * 20_000])
def test_classes_see_every_byte(text):
    for at in {0, len(text) // 2, len(text) - 1} if text else ():
        other = text[:at] + "ü" + text[at + 1 :]
        assert fa.classes(text.encode(), len(text))[-1] != fa.classes(other.encode(), len(text))[-1]


def test_empty_tables(spark):
    d, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], LABELS)
    assert fa.interactions(fa.mask_counts(d, labels)).count() == 0
    one = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    rows = fa.interactions(fa.mask_counts(one, labels)).collect()
    assert len(rows) == 600 and all(r.kept == (r.step <= r.filter_order.index("A")) for r in rows)  # it fails A alone
    assert {r.shapley for r in rows} == {0, 120}
