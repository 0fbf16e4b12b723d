"""Word sequences of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """The runs of letters and digits of a text, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]++"), F.lit(0))


def word_codes(text: Column) -> Column:
    """64-bit hashes of the words of a text."""
    return F.transform(words(text), lambda w: F.xxhash64(w))
