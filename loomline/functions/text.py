"""Text cleaning and question keys as built-in column expressions (no Python in the hot path).

Java's ``\\s`` and ``\\w`` are ASCII; the classes below cover what Python's
Unicode classes cover: separators, the information separators U+001C..U+001F
and NEL count as white space, letters and numbers of any script as word
characters. Combining marks count as punctuation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\p{Z}\x1c-\x1f\x{85}]+"
PUNCTUATION = r"[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x{85}]"


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_text(value: str | Column) -> Column:
    """Outer blanks removed, runs of white space to one blank; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(_column(value).cast("string"), F.lit("")), WHITE, " "))


def key_without_marks(value: str | Column) -> Column:
    """N1: clean, lower case, punctuation deleted, white space collapsed."""
    return clean_text(F.regexp_replace(F.lower(clean_text(value)), PUNCTUATION, ""))


def key_marks_to_blanks(value: str | Column) -> Column:
    """N2: as N1, but punctuation becomes a blank."""
    return clean_text(F.regexp_replace(F.lower(clean_text(value)), PUNCTUATION, " "))


def key_with_marks(value: str | Column) -> Column:
    """N3: lower case and collapsed white space; punctuation stays."""
    return clean_text(F.lower(F.coalesce(_column(value).cast("string"), F.lit(""))))


def key_trimmed(value: str | Column) -> Column:
    """N4: lower case without outer blanks; inner white space stays."""
    return F.lower(F.regexp_replace(F.coalesce(_column(value).cast("string"), F.lit("")), rf"^{WHITE}|{WHITE}$", ""))


def or_default(value: str | Column, default: str) -> Column:
    """Cleaned text, or the default where it is empty."""
    return F.coalesce(F.nullif(clean_text(value), F.lit("")), F.lit(default))


def distinct_tokens(value: str | Column) -> Column:
    """Number of distinct blank-separated tokens; 0 for empty text."""
    text = F.lower(clean_text(value))
    return F.when(text == "", 0).otherwise(F.size(F.array_distinct(F.split(text, " "))))
