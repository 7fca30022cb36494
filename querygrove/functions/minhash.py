"""MinHash signatures and bands as columns, without a shuffle per value."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from .text import let

# The hash family is (a * h + b) mod PRIME over 32-bit h, with
# a below 2**30 so that every product fits a signed 64-bit number.
PRIME = 4294967311
PERMUTATIONS = 100
SHINGLE = 3
BANDS = 25
BAND_KEY_DIGITS = 15
KEPT_SIGNATURES = 50_000


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def coefficients(permutations: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """The pairs (a, b) of the hash family, from digests of their numbers."""
    return [(_number(f"a{i}") % 2**30 + 1, _number(f"b{i}")) for i in range(permutations)]


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """The set of character n-grams; a shorter text is its own only one."""
    last = F.length(text) - F.lit(size - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                        lambda i: F.substring(text, i, F.lit(size)))
    return F.when(last < 1, F.array(text)).otherwise(F.array_distinct(grams))


def _signatures(permutations: int, size: int):
    """A batch function: texts to their smallest shingle hash per permutation."""
    family = coefficients(permutations)

    def smallest(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=object)
        cut = [{t[i:i + size] for i in range(len(t) - size + 1)} or {t} for t in texts]
        known = {gram: _number(gram) for gram in set().union(*cut)}
        flat = np.array([known[gram] for grams in cut for gram in grams], dtype=np.int64)
        sizes = np.array([len(grams) for grams in cut])
        starts = np.cumsum(sizes) - sizes
        columns = [np.minimum.reduceat((a * flat + b) % PRIME, starts) for a, b in family]
        return pd.Series(list(np.stack(columns, axis=1)))

    return F.pandas_udf(smallest, ArrayType(LongType()))


def estimated_of_texts(left: Column, right: Column) -> Column:
    """:func:`estimated_jaccard` of the signatures of two texts, neither null.

    Rows of equal texts should stand near each other: signatures of the last
    ``KEPT_SIGNATURES`` texts or so are kept and not made again.
    """
    sign = _signatures(PERMUTATIONS, SHINGLE).func

    def share(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        places, rows = {}, np.empty((0, PERMUTATIONS), dtype=np.int64)
        for a, b in batches:
            codes, texts = pd.factorize(pd.concat([a, b], ignore_index=True))
            if len(places) > KEPT_SIGNATURES:
                places, rows = {}, rows[:0]
            new = [t for t in texts if t not in places]
            if new:
                places.update(zip(new, range(len(rows), len(rows) + len(new))))
                rows = np.concatenate([rows, np.stack(sign(pd.Series(new)).to_list())])
            at = np.array([places[t] for t in texts], dtype=np.int64)[codes]
            ours, theirs = at[:len(a)], at[len(a):]
            same = [(rows[ours[i:i + 1024]] == rows[theirs[i:i + 1024]]).sum(axis=1) for i in range(0, len(a), 1024)]
            yield pd.Series(np.concatenate(same) / PERMUTATIONS if same else [], dtype="float64")

    return F.pandas_udf(share, DoubleType())(left, right)


def signature(text: Column, permutations: int = PERMUTATIONS, size: int = SHINGLE) -> Column:
    """The smallest hash of any shingle under each permutation.

    A few thousand products per value: they are taken in Arrow batches, a
    hundred times faster than by nested lambdas.  The text must not be null.
    """
    return _signatures(permutations, size)(text)


def bands(sig: Column, permutations: int = PERMUTATIONS, n_bands: int = BANDS) -> Column:
    """One key per band: a 60-bit digest of its number and its rows."""
    rows = permutations // n_bands

    def key(values: Column, i: Column) -> Column:
        text = F.concat_ws("-", i.cast("string"), F.slice(values, i * rows + 1, F.lit(rows)))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, BAND_KEY_DIGITS), 16, 10).cast("bigint")

    return let(sig.cast("array<string>"), lambda values: F.transform(
        F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: key(values, i)))


def estimated_jaccard(left: Column, right: Column) -> Column:
    """Share of positions at which two signatures agree."""
    same = F.filter(F.zip_with(left, right, lambda a, b: a == b), lambda x: x)
    return F.size(same) / F.size(left)
