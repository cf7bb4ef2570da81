"""Word columns made of built-in functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that is no word character once A-Z are lower case.
ITEM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Found in a text that has an item word.
HAS_WORD = r"[0-9A-Za-z]|[^\x00-\x7F]"
#: White space as the size of a document counts it.
BLANK = r"[\x20\x09-\x0D]+"
NON_BLANK = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z, and only those, in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def item_words(text: Column) -> Column:
    """Lower-case words of letters, digits and all characters beyond ASCII; none for null."""
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), ITEM_GAP), "")


def blank_word_count(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(NON_BLANK)), F.lit(0)).cast("long")


def long_array(values: list[int]) -> Column:
    """A constant array of longs that the optimizer folds into one literal."""
    if not values:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
