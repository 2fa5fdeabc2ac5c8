"""Column expressions on texts, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What keeps words apart, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def split_words(text: Column, apart: str = SPACE + "+") -> Column:
    """The text cut at ``apart``; the first and last pieces may be empty (see :func:`inner`)."""
    return F.split(F.coalesce(text, F.lit("")), apart)


def n_inner(parts: Column) -> Column:
    """How many words ``parts`` holds."""
    return F.greatest(F.lit(0), F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int") - (F.element_at(parts, -1) == "").cast("int"))


def inner(parts: Column) -> Column:
    """``parts`` without the empty ends."""
    return F.slice(parts, F.when(F.get(parts, F.lit(0)) == "", 2).otherwise(1), n_inner(parts))
