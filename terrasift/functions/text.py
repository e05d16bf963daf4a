"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Polish letters and what they become; fixed by the alphabet.
POLISH, PLAIN = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "acelnoszzACELNOSZZ"


def plain(text: str | Column) -> Column:
    """Polish letters without their marks."""
    return F.translate(F.col(text) if isinstance(text, str) else text, POLISH, PLAIN)


def first_match(text: Column, *patterns: str) -> Column:
    """The first group of the first pattern that matches; null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def without_suffix(text: Column, suffix: str) -> Column:
    """The text without a word at its end, and the white space before it."""
    return F.regexp_replace(text, rf"\s*{suffix}\s*$", "")


def blocks(text: Column, separator: str = r"\n\s*\n") -> Column:
    """The non-empty blocks of a text."""
    return F.filter(F.transform(F.split(text, separator), lambda b: F.trim(b)), lambda b: b != "")


def gps_week(date: Column) -> Column:
    """Whole weeks since the GPS epoch, 1980-01-06."""
    return F.floor(F.datediff(date, F.to_date(F.lit("1980-01-06"))) / 7)


def gps_time(week: Column, second: Column) -> Column:
    """Adjusted standard GPS time of a second of a week, with 18 leap seconds."""
    return second + week * 604800 + 18 - 1_000_000_000
