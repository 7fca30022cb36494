"""Reads of a table, bounded only where the caller says so, in an order the caller names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import seeded_digest

DEFAULT_ROWS = 5000
RANDOM_OF_FIRST = 10


def fetch(df: DataFrame, mode: str | int = "all", order: list[str] | None = None, seed: int = 42) -> DataFrame:
    """All rows, one, the first ``mode`` rows, or a random one of the first ten."""
    ordered = df.orderBy(*order) if order else df
    if mode == "all":
        return ordered
    if mode == "one":
        return ordered.limit(1)
    if mode == "random":
        first = ordered.limit(RANDOM_OF_FIRST)
        return first.orderBy(seeded_digest(seed, *[F.col(c) for c in order or df.columns])).limit(1)
    if isinstance(mode, int):
        return ordered.limit(mode)
    raise ValueError("mode must be 'all', 'one', 'random' or a number of rows")
