"""Whitespace, word and seeded-hash helpers shared by all column expressions.

The patterns are accepted by Java's and by RE2's regex syntax alike, so the
same text can be used in a DuckDB check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip`` and ``\s`` treat as
# blank, and the characters its ``\w`` treats as part of a word.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value computed once.

    An expression named inside a lambda is evaluated again for every element;
    a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Remove blanks of any kind at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def collapse_blanks(text: Column) -> Column:
    """Every run of blanks becomes one space, none is left at the ends."""
    return F.trim(F.regexp_replace(text, rf"{BLANK}+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def count_literal(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(literal)))
    return (gone / F.lit(len(literal))).cast("int")


def seeded_digest(seed: int | str, *keys: Column) -> Column:
    """Hex digest of the keys under a seed: the stand-in for a random number.

    It depends on the row alone, so a result does not change with the number
    of partitions, with retries or with lost executors.
    """
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def seeded_uint32(seed: int | str, *keys: Column) -> Column:
    """The first 32 bits of :func:`seeded_digest` as a bigint."""
    return F.conv(F.substring(seeded_digest(seed, *keys), 1, 8), 16, 10).cast("bigint")
