"""Small text helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Remove white space, line breaks included, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def source_key(encoded: Column) -> Column:
    """The plain path of a percent-encoded file path; a literal plus stays a plus."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def contains_all(text: Column, *needles: str) -> Column:
    """Case-insensitive: every needle occurs in the text."""
    lowered = F.lower(text)
    found = F.lit(True)
    for needle in needles:
        found = found & lowered.contains(needle.lower())
    return found
