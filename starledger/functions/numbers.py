"""Header numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_int(text: Column | str) -> Column:
    """A 32-bit integer, or null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int"))


def parsed_float(text: Column | str) -> Column:
    """A real number, or null; the exponent may be marked by D. Suffixes, infinities and NaN are no numbers."""
    t = F.replace(F.replace(F.trim(text), F.lit("D"), F.lit("E")), F.lit("d"), F.lit("e"))
    return F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[Ee][+-]?\d+)?$"), t.try_cast("double"))
