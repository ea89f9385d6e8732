"""Column helpers shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "<REDACTED>"
WINDOW = 20  # characters kept on each side of a redacted secret


def sql_literal(value: str) -> str:
    """A string as a literal of Spark SQL, whatever characters it holds.

    Anything but plain letters and digits goes as bytes: how the parser reads backslashes in strings is up
    to a session setting.
    """
    if value.isascii() and value.replace("_", "").replace(" ", "").isalnum():
        return f"'{value}'"
    return f"decode(X'{value.encode().hex()}', 'UTF-8')"


def regex_group(text: Column, pattern: str | Column, group: int | Column) -> Column:
    """A group of the first match; pattern and group may be columns."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    group = F.lit(group) if isinstance(group, int) else group
    return F.call_function("regexp_extract", text, pattern, group)


def contains_ignore_case(text: Column, needle: str | Column) -> Column:
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(text), F.lower(needle))


def cut(text: Column, begin: Column, end: Column) -> Column:
    """Characters ``begin`` (0-based) up to but not including ``end``."""
    return F.substring(text, begin + F.lit(1), F.greatest(end - begin, F.lit(0)))


def window_around(text: Column, begin: Column, end: Column, chars: int, middle: Column) -> Column:
    """``middle`` with up to ``chars`` characters of the text on each side."""
    start = F.greatest(begin - F.lit(chars), F.lit(0))
    return F.concat(cut(text, start, begin), middle, cut(text, end, end + F.lit(chars)))


def count_of(text: Column, needle: str) -> Column:
    """Occurrences of a single character."""
    return F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))


def shannon_entropy(text: Column) -> Column:
    """Bits per character of the text's character distribution; 0 for an empty text.

    The characters are bound once, as the one element of an array: a filter on the result may be
    pushed below the projection that makes the text, which would then run again for every character.
    """

    def bits(chars: Column) -> Column:
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
        return F.aggregate(
            F.transform(F.array_distinct(chars), share), F.lit(0.0), lambda acc, p: acc - p * F.log2(p)
        )

    return F.transform(F.array(F.split(text, "")), bits)[0]


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def parse_message_link(link: Column) -> Column:
    """``…/archives/<channel>/p<digits>`` as (channel_id, thread_ts); two empty strings otherwise."""
    pattern = r"archives/([^/]+)/p([0-9]+)"
    digits = F.regexp_extract(link, pattern, 2)
    ts = F.when(digits != "", F.concat(F.substring(digits, 1, 10), F.lit("."), F.substring(digits, 11, 1 << 20)))
    return F.struct(
        F.coalesce(F.regexp_extract(link, pattern, 1), F.lit("")).alias("channel_id"),
        F.coalesce(ts, F.lit("")).alias("thread_ts"),
    )
