"""Words of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parts words where punctuation counts: brackets, stops, white space.
PUNCTUATION = r"[\(\[,.!?:;\]\)\s]"


def split_words(text) -> Column:
    """Lower-cased pieces between punctuation and white space, empty ones dropped."""
    return F.filter(F.split(F.lower(text), PUNCTUATION), lambda w: w != "")


def letter_words(text) -> Column:
    """Runs of a to z of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)


def parts(text, delimiter: str = ",") -> Column:
    """A delimited list, each part trimmed."""
    return F.transform(F.split(text, delimiter), lambda x: F.trim(x))
