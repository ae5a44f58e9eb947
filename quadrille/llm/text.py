"""Native text expressions shared by the operators.

White space everywhere means the six code points ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def filled(text: Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(text, F.lit(""))


def without_whitespace(text: Column) -> Column:
    """``text`` with every white-space character deleted (byte-level, no regex)."""
    out = filled(text)
    for c in WHITESPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-white-space characters, as long; null gives 0."""
    inner = F.btrim(filled(text), F.lit(WHITESPACE))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")
