"""String functions. Positions count from 0; null arguments give null unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.logic import lit


def combine(items: Column, separator: str = "") -> Column:
    """Null for an empty list and for one that holds a null."""
    bad = (F.size(items) == 0) | F.exists(items, lambda x: x.isNull())
    return F.when(~bad, F.array_join(items, separator))


def concatenate(*parts) -> Column:
    return F.concat(*[lit(p) for p in parts])


def starts_with(a, b) -> Column:
    return F.startswith(lit(a), lit(b))


def ends_with(a, b) -> Column:
    return F.endswith(lit(a), lit(b))


def char_at(a, i) -> Column:
    """Null out of range."""
    a, i = lit(a), lit(i)
    return F.when((i >= 0) & (i < F.length(a)), F.substring(a, i + 1, F.lit(1)))


def position_of(pattern, a) -> Column:
    """-1 if absent."""
    return F.position(lit(pattern), lit(a)) - 1


def last_position_of(pattern, a) -> Column:
    p, s = lit(pattern), lit(a)
    back = F.position(F.reverse(p), F.reverse(s))
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(s) - back - F.length(p) + 1)


def length(a) -> Column:
    """The length of null is 0."""
    return F.coalesce(F.length(lit(a)), F.lit(0))


def lower(a) -> Column:
    return F.lower(lit(a))


def upper(a) -> Column:
    return F.upper(lit(a))


def matches(a, pattern: str) -> Column:
    """The whole string has to match."""
    return F.rlike(lit(a), F.lit(rf"\A(?:{pattern})\z"))


def replace_matches(a, pattern: str, by: str) -> Column:
    return F.regexp_replace(lit(a), pattern, by)


def split(a, separator: str | None) -> Column:
    """By a separator of one character. One empty part at the end is dropped; without a separator the string is whole."""
    if not separator:
        return F.when(lit(a).isNotNull(), F.array(lit(a)))
    if len(separator) > 1:
        raise ValueError("separators have one character")
    parts = F.split(lit(a), re.escape(separator), -1)
    n = F.size(parts)
    return F.when((n > 1) & (F.get(parts, n - 1) == ""), F.slice(parts, F.lit(1), n - 1)).otherwise(parts)


def substring(a, start, size=None) -> Column:
    """Null if the start is out of range; the length is clipped."""
    a, i = lit(a), lit(start)
    n = F.length(a) if size is None else lit(size)
    return F.when((i >= 0) & (i < F.length(a)), F.substring(a, i + 1, n))


def to_chars(a) -> Column:
    return F.when(lit(a) == "", F.array().cast("array<string>")).otherwise(F.split(lit(a), ""))


def normalized(a) -> Column:
    """For prefix search: punctuation becomes space, runs of space one, ends trimmed, lower case."""
    spaced = F.regexp_replace(lit(a), r"[\p{Punct}]", " ")
    return F.lower(F.trim(F.regexp_replace(spaced, r"\s+", " ")))


def phonetic(a) -> Column:
    """Soundex; null for null and empty strings."""
    return F.nullif(F.soundex(lit(a)), F.lit(""))
