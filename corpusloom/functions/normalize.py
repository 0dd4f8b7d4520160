"""Unicode text to readable ASCII with explicit code-point markers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Punctuation with an ASCII equivalent.
PUNCTUATION = {
    "“": '"',
    "”": '"',
    "„": '"',
    "‟": '"',
    "‘": "'",
    "’": "'",
    "‚": "'",
    "‛": "'",
    "–": "-",
    "—": "-",
    "―": "-",
    "…": "...",
    "፣": ",",
    "።": ".",
    "፤": ";",
    "፥": ":",
    "፦": ":",
    "፧": "?",
    "፨": ".",
}
_OTHER = re.compile(r"[^\x20-\x7E]+")


def marker(ch: str, prefix: str = "") -> str:
    return f"{prefix}[U+{ord(ch):04X} {unicodedata.name(ch, 'UNNAMED CHARACTER')}]"


def described(ch: str, transliterate: Callable[[str], str] | None = None) -> str:
    """What stands for one character: printable ASCII itself, other ASCII a space, and else a readable prefix with its marker."""
    if ch.isascii():
        return ch if ch.isprintable() else " "
    prefix = "".join(map(described, transliterate(ch))).strip() if transliterate else ""
    return marker(ch, prefix or unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode())


class _Table(dict):
    """Code point to replacement, filled as characters are met: punctuation and white space have theirs, others are described."""

    def __init__(self, transliterate: Callable[[str], str] | None = None):
        super().__init__()
        self.transliterate = transliterate

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        self[cp] = out = PUNCTUATION.get(ch) or (" " if ch.isspace() else described(ch, self.transliterate))
        return out


@lru_cache
def _table(transliterate: Callable[[str], str] | None = None) -> _Table:
    return _Table(transliterate)


def normalize_text(text: str | bytes | None, transliterate: Callable[[str], str] | None = None) -> str | None:
    """One text in plain Python. The result is ASCII with single spaces; None stays None."""
    if text is None:
        return None
    if isinstance(text, bytes):
        text = text.decode("utf-8", errors="replace")
    table = _table(transliterate)
    return " ".join(_OTHER.sub(lambda m: m[0].translate(table), unicodedata.normalize("NFKC", text)).split())  # printable ASCII stays, and is not looked up


def normalize(text: Column, transliterate: Callable[[str], str] | None = None) -> Column:
    """The same as a column. ASCII rows stay in the JVM; only the others reach Python, in Arrow batches.

    Normalise lines, not blobs of them: line ends become spaces. A transliterator is a function of a character that
    workers can import or unpickle.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)

    def normalized(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: normalize_text(t, transliterate), na_action="ignore")

    ascii_only = F.trim(F.regexp_replace(text, r"[\x00-\x20\x7F]+", " "))
    other = F.pandas_udf(normalized, "string")(F.when(text.rlike(r"[^\x00-\x7F]"), text))
    return F.coalesce(other, ascii_only)


MARKER = r"\[U\+[0-9A-Fa-f]{4,6} [^\]]+\]"


def markers(text: Column) -> Column:
    """All markers of a normalised text, in order."""
    return F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))
