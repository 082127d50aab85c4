"""Small text helpers shared by every operator. All work inside Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.catalogue import SPACE, SPACE_CHARS


# --- fixed values: every space character, for trimming
EVERY_SPACE = SPACE_CHARS.replace("\u2000-\u200a", "".join(chr(c) for c in range(0x2000, 0x200B)))


def trim_space(text: Column) -> Column:
    """Trim every Unicode space, not only the ASCII blank."""
    return F.trim(text, F.lit(EVERY_SPACE))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", " ")


def clean_text(text: Column) -> Column:
    return trim_space(F.coalesce(text, F.lit("")))


def capitalise(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def has_any(text: Column, pattern: str) -> Column:
    """Case-insensitive search under ASCII folding."""
    return text.rlike("(?i)" + pattern)
