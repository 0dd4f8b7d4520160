import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.functions import normalize as normalize_module
from corpusloom.functions.normalize import marker, normalize, normalize_text

GOLDEN = [
    ("é", "e[U+00E9 LATIN SMALL LETTER E WITH ACUTE]"),
    ("ß", "[U+00DF LATIN SMALL LETTER SHARP S]"),
    ("ẹ́", "e[U+1EB9 LATIN SMALL LETTER E WITH DOT BELOW][U+0301 COMBINING ACUTE ACCENT]"),
    ("ǃ", "[U+01C3 LATIN LETTER RETROFLEX CLICK]"),
    ("።", "."),
    ("…", "..."),
    ("ﬁ", "fi"),
    ("½", "1[U+2044 FRACTION SLASH]2"),
    ("“a”—b", '"a"-b'),
    ("a\t b\xa0c\x00\x7f", "a b c"),
    ("", ""),
    (" \t ", ""),
    ("\x00", ""),
]


@pytest.mark.parametrize("text,want", GOLDEN)
def test_golden(text, want):
    assert normalize_text(text) == want


def test_bytes_and_none_and_hook():
    assert normalize_text(b"a\xffb") == "a[U+FFFD REPLACEMENT CHARACTER]b"
    assert normalize_text(None) is None
    assert normalize_text("ж", lambda c: "zh") == "zh[U+0436 CYRILLIC SMALL LETTER ZHE]"


def test_column_equals_function(spark):
    texts = [t for t, _ in GOLDEN] + [None, "plain  text\n", "a\x1cb", "naïve café\r\nx", "\x85y", "ＡＢＣ", "한국어 text"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(map(tuple, df.select("i", normalize(df.t)).collect()))
    assert got == {i: normalize_text(t) for i, t in enumerate(texts)}


def test_column_with_transliterator(spark):
    df = spark.createDataFrame([("жa",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(normalize(df.t, lambda c: "zh")).collect()] == ["zh[U+0436 CYRILLIC SMALL LETTER ZHE]a", "plain", None]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_ascii_and_idempotent(text):
    text = text.encode("utf-8", "ignore").decode()
    out = normalize_text(text)
    assert out.isascii() and out == out.strip() and "  " not in out
    assert normalize_text(out) == out
    assert unicodedata.is_normalized("NFKC", out)


def test_printable_ascii_is_not_looked_up(monkeypatch):
    """Only what is beyond it costs a look-up, in whatever script the text is."""
    seen = []

    class Counting(dict):
        def __missing__(self, cp):
            seen.append(chr(cp))
            return normalize_module.described(chr(cp))

    monkeypatch.setattr(normalize_module, "_table", lambda transliterate=None: Counting())
    assert normalize_text("plain words, \u00e9 more") == "plain words, " + marker("\u00e9", "e") + " more" and seen == ["\u00e9"]


def test_white_space_of_all_kinds_and_punctuation():
    assert normalize_text("\u2003\u201ca\u2028b\x07c\u0085\u00a0d\u2026\u201d\x1f") == '"a b c d..."'
