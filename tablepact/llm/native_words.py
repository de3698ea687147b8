"""Words of a text in Spark's own functions.

Texts are split at what lies between words: matching the words themselves, by a negated class, takes Java's
regular expressions ten times as long.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

#: What isn't an ASCII letter or digit, nor outside ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def words(text: Column) -> Column:
    """The lower-cased words of a text; none for null."""
    return _split(lower_ascii(F.coalesce(text, F.lit(""))))


def count_words(text: Column) -> Column:
    """The number of ``words``."""
    return F.size(_split(F.coalesce(text, F.lit("")))).cast("long")
