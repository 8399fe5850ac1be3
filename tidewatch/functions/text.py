"""Column functions for review text."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters that count as white space.
SPACE_CHARS = (
    r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = f"[{SPACE_CHARS}]"
NON_SPACE = f"[^{SPACE_CHARS}]"
# Control characters that never carry text (tab, newline and return are white space).
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
LETTER_OR_DIGIT = r"[\p{L}\p{N}]"
TOKEN = r"[\p{L}\p{N}_]{2,}"


# Characters that are their own NFKC form and never combine with a neighbour: ASCII, Latin-1
# letters, most of Latin Extended-A, Greek, Cyrillic, Hebrew and Arabic letters, Thai
# consonants, kana, CJK ideographs, dashes and quotes.
_PLAIN = (r"[\x00-\x7f\xc0-\xff\u0100-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e"
          r"\u0391-\u03a1\u03a3-\u03c9\u0400-\u0482\u048a-\u052f\u05d0-\u05ea"
          r"\u0621-\u063a\u0641-\u064a\u0660-\u0669\u0e01-\u0e30\u3001\u3002\u3041-\u3094"
          r"\u30a1-\u30f4\u4e00-\u9fa5\u2013\u2014\u2018\u2019\u201c\u201d]*")


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    # pyarrow's own utf8_normalize leaves composed forms decomposed.
    return pa.array(
        [None if s is None else unicodedata.normalize("NFKC", s) for s in text.to_pylist()],
        pa.string())


# Not marked as deterministic, so that a filter on the result is not pushed below with a
# second evaluation.
_nfkc = _nfkc.asNondeterministic()


def nfkc(text: Column) -> Column:
    """Unicode NFKC form. Plain text is its own NFKC form and never leaves the JVM."""
    other = F.when(~text.rlike(f"^{_PLAIN}$"), text)
    return F.coalesce(_nfkc(other), text)


def is_blank(text: Column) -> Column:
    """NULL, empty or white space only."""
    return text.isNull() | ~text.rlike(NON_SPACE)


def clean_text(text: Column) -> Column:
    """Normalized lower-case text that keeps every word; NULL becomes ''."""
    out = nfkc(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, CONTROL, " ")
    out = F.regexp_replace(out, r"([!?.,])\1{2,}", "$1$1")
    out = F.regexp_replace(out, f"{SPACE}+", " ")
    return F.lower(F.trim(out))


def has_content(text: Column) -> Column:
    """At least one letter or digit, in any script."""
    return F.coalesce(text.rlike(LETTER_OR_DIGIT), F.lit(False))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for NULL and ''."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{NON_SPACE}+")), F.lit(0)).cast("bigint")


def tokens(text: Column) -> Column:
    """Runs of two or more word characters, in text order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))
