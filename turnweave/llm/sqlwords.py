"""Words in DataFrame expressions: runs of digits, ASCII letters (A-Z lowered) and anything above U+007F."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes for Java regular expressions over texts in either case; plain ranges match several times faster than their complements.
IN_WORD = r"[a-zA-Z0-9\x80-\x{10FFFF}]"
OUT_OF_WORD = r"[^a-zA-Z0-9\x80-\x{10FFFF}]"
WORD = IN_WORD + "+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z lowered and nothing else; all-ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.coalesce(F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once; lambda bodies evaluate what they mention for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)
