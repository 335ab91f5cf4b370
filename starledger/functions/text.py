"""Text expressions. Stored names compare without ASCII case only, so ``lower`` and ``ilike`` don't do."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def nocase(col: Column | str) -> Column:
    """A comparison key: A-Z become a-z, all else stays."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def nocase_text(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def contains_pattern(text: str) -> str:
    """A LIKE pattern for text anywhere: ``%`` and ``_`` of the text are wild, a backslash is itself."""
    return "%" + nocase_text(text).replace("\\", "\\\\") + "%"


def contains(col: Column | str, text: str) -> Column:
    return nocase(col).like(contains_pattern(text))


def filename(path: Column | str) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def truncated(col: Column | str, length: int) -> Column:
    """Longer texts end in three points and have ``length`` characters (three at least)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.length(c) <= length, c).otherwise(F.concat(F.substring(c, 1, max(0, length - 3)), F.lit("...")))


def humanised(col: Column | str) -> Column:
    """Title case of a name written in camel case, snake case or with hyphens."""
    spaced = F.regexp_replace(F.regexp_replace(col, r"[_-]+", " "), r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.initcap(F.trim(spaced))


def blank_as_none(col: Column | str) -> Column:
    """Null, empty and white-space texts become 'None'."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull() | (F.trim(F.regexp_replace(c, r"\s+", " ")) == ""), F.lit("None")).otherwise(c)


def split_parts(col: Column | str) -> Column:
    """The parts of a text between ``|`` signs."""
    return F.split(col, r"\|")


def hours_text(hours: Column) -> Column:
    """Hours with one decimal, below one hour with two."""
    return F.when(hours < 1, F.format_string("%.2f", hours)).when(hours >= 1, F.format_string("%.1f", hours))


def gigabytes_text(size: Column) -> Column:
    return F.format_string("%.2f GB", size / float(1 << 30))
