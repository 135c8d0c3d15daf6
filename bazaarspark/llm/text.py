"""Column expressions and byte helpers that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space. ``bytes.split()`` splits at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def lower_az(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def count_words(col: Column) -> Column:
    """Number of words; null counts as 0."""
    marks = F.regexp_replace(F.coalesce(col, F.lit("")), WORD, "\x01")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
