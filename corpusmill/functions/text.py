"""Text columns: trimming by Unicode white space, white-space cleaning, length filter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a JavaScript engine counts as white space.
WHITE = "".join(map(chr, [9, 10, 11, 12, 13, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_CLASS = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in WHITE) + "]"


def trim(text: Column) -> Column:
    """Strip Unicode white space (Spark's own trim strips spaces only)."""
    return F.regexp_replace(text, rf"^{_CLASS}+|{_CLASS}+\z", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(trim(text) == "", F.lit(True))


def clean_whitespace(text: Column) -> Column:
    """Runs of blanks to one space, no space beside a line feed, at most one empty line, trimmed."""
    out = F.regexp_replace(text, r"[ \t]+", " ")
    out = F.regexp_replace(out, r" \n", "\n")
    out = F.regexp_replace(out, r"\n ", "\n")
    return trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def long_enough(text: Column, least: int = 100) -> Column:
    return F.char_length(text) >= least
