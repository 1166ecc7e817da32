"""Counting, sentence splitting, chunking, hashing and small string rules."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters that stripping removes (Unicode white space without the
# non-breaking spaces), the control range that plain trimming removes, and the marks that
# end a sentence.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a"
    "\u2028\u2029\u205f\u3000"
)
TRIM_CHARS = "".join(chr(i) for i in range(0x21))
SENTENCE_END = "(?<=[।॥.?!])\\s+|\\n+"

TRANSLATE_LIMIT = 2000
SPEECH_LIMIT = 2500
ERROR_LIMIT = 2000

# First code point that Unicode normalisation may compose with its neighbour; text made
# only of lower code points is already in composed form.
FIRST_COMPOSING = "\\x{300}"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    return F.btrim(as_column(value), F.lit(STRIP_CHARS))


def is_blank(value: Column | str) -> Column:
    """True for null and for text of white space only."""
    return F.coalesce(strip(value) == "", F.lit(True))


def word_count(value: Column | str) -> Column:
    """Number of white-space separated words; 0 for null or blank text."""
    text = as_column(value)
    words = F.regexp_count(F.btrim(text, F.lit(TRIM_CHARS)), F.lit("\\S+"))
    return F.when(is_blank(text), 0).otherwise(F.greatest(words, F.lit(1))).cast("int")


def sentences(value: Column | str) -> Column:
    """Stripped, non-blank sentences in order."""
    pieces = F.split(as_column(value), SENTENCE_END)
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def _packing_pattern(limit: int) -> str:
    # Input: sentences joined by newlines, which no sentence contains. In order of preference
    #   whole sentences, as many as fit, from the start of one to the end of another;
    #   inside a sentence that cannot fit: as many characters as fit up to a space or its end;
    #   a word that cannot fit: exactly `limit` characters.
    start, end = "(?<![^\\n])", "(?![^\\n])"
    whole = f"{start}.{{1,{limit}}}{end}"
    up_to_space = f"[^\\n]{{1,{limit}}}(?![^ \\n])"
    forced = f"[^\\n]{{{limit}}}"
    gap = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in STRIP_CHARS) + "]*+"
    return f"(?s){gap}({whole}|{up_to_space}|{forced})"


def chunk(value: Column | str, limit: int = TRANSLATE_LIMIT) -> Column:
    """Pack sentences greedily into pieces of at most ``limit`` characters.

    Sentences share a piece separated by one space. One that is longer than ``limit`` gets
    pieces of its own, see :func:`hard_split`. The greedy packing is what a greedy regular
    expression does, so the whole operator is one built-in pass over the text.
    """
    joined = F.array_join(sentences(value), "\n")
    pieces = F.regexp_extract_all(joined, F.lit(_packing_pattern(limit)), 1)
    return F.transform(pieces, lambda p: F.replace(strip(p), F.lit("\n"), F.lit(" ")))


def hard_split(value: Column | str, limit: int) -> Column:
    """Cut one long sentence at the last space within ``limit``, or at ``limit`` where there is none."""
    one_line = F.replace(strip(value), F.lit("\n"), F.lit(" "))
    return F.transform(F.regexp_extract_all(one_line, F.lit(_packing_pattern(limit)), 1), strip)


@F.pandas_udf(StringType())
def _compose(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def nfc(value: Column | str) -> Column:
    """Unicode composed form. Only rows that may need composing are sent to Python."""
    text = as_column(value)
    needs = text.rlike(f"[{FIRST_COMPOSING}-\\x{{10FFFF}}]")
    return F.coalesce(_compose(F.when(needs, text)), text)


def digest(value: Column | str) -> Column:
    """SHA-256 hex of stripped text that is already in composed form."""
    return F.sha2(strip(value), 256)


def content_hash(value: Column | str) -> Column:
    """SHA-256 hex of the composed, stripped text; null for null."""
    return digest(nfc(value))


def truncate_error(value: Column | str, limit: int = ERROR_LIMIT) -> Column:
    return F.substring(as_column(value), 1, limit)


def escape_like(value: Column | str) -> Column:
    """Escape the LIKE wildcards and the escape character itself."""
    return F.regexp_replace(as_column(value), "([\\\\%_])", "\\\\$1")


def normalise_for_scoring(value: Column | str) -> Column:
    """Composed form, white-space runs collapsed to one space, ends stripped."""
    return strip(F.regexp_replace(nfc(value), "\\s+", " "))
