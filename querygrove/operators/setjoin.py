"""Joining sets of tokens by Jaccard similarity, exactly and without all pairs.

Tokens of a set are ordered by how many sets hold them, the rarest first.  Two
sets as alike as the threshold asks share a token among the first few of each,
so only those prefixes meet, and what everybody has is looked at last.  Sizes
and places of the shared token rule out most of the rest before the sets are
compared.  Thresholds are whole percents, so every bound is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_and_read
from .joins import hot_counted, hot_salted_lookup, union_all

# Shared tokens of two sides that a task looks at together.
MEETINGS = 1_000_000


def token_counts(sets: DataFrame, by: str, tokens: str = "tokens") -> DataFrame:
    """``by, token, held``: how many sets of a group hold a token; stored."""
    each = sets.select(by, F.explode(tokens).alias("token"))
    return write_and_read(each.groupBy(by, "token").agg(F.count(F.lit(1)).alias("held")), "token-counts")


def _hot(counts: DataFrame, by: str) -> DataFrame:
    """Tokens that a large part of all sets' tokens are, as :func:`.joins.hot_keys` would find them."""
    return hot_counted(counts, [by, "token"], "held")


def rarest_first(sets: DataFrame, counts: DataFrame, by: str, key: str, tokens: str = "tokens") -> DataFrame:
    """``sets``, each key once, with its tokens by rising count; stored.

    Tokens that the counts lack come first.
    """
    rest = [c for c in sets.columns if c not in (by, key, tokens)]
    each = sets.select(by, key, F.struct(*rest, F.lit(0).alias("_")).alias("_rest"), F.explode(tokens).alias("token"))
    known = hot_salted_lookup(each, counts, [by, "token"], "left", hot=_hot(counts, by))
    # One list is as long as one set.
    placed = F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "token")))
    ordered = known.groupBy(by, key).agg(F.first("_rest").alias("_rest"), F.transform(placed, lambda t: t["token"]).alias(tokens))
    return write_and_read(ordered.select(by, key, *[f"_rest.{c}" for c in rest], tokens), "token-sets")


def least(percent: int, size: Column) -> Column:
    """The least overlap with any similar set: ``percent`` of the size, rounded up."""
    return F.floor((size * percent + 99) / 100)


def prefixes(sets: DataFrame, by: str, key: str, percent: int, side: str) -> DataFrame:
    """The first tokens of each set, enough to meet every set that is ``percent`` alike, with their place and its size."""
    size = F.size("tokens")
    return sets.select(by, key, size.alias(f"{side}_size"), F.posexplode(
        F.slice("tokens", F.lit(1), (size - least(percent, size) + 1).cast("int"))).alias(f"{side}_at", "token"))


def may_be_alike(percent: int) -> Column:
    """Whether the sizes of two sets and the places of a token that both prefixes have allow ``percent``."""
    a, b = F.col("left_size"), F.col("right_size")
    sizes = (a * 100 >= b * percent) & (b * 100 >= a * percent)
    overlap = F.least(a - F.col("left_at"), b - F.col("right_at"))  # at most, if this is the first shared token
    return sizes & (overlap * (100 + percent) >= (a + b) * percent)


def compared(both: DataFrame, percent: int) -> DataFrame:
    """Pairs with the tokens of both sides as ``_a`` and ``_b``: those that are ``percent`` alike, as ``common`` of ``either``."""
    sized = both.withColumn("common", F.size(F.array_intersect("_a", "_b"))).withColumn(
        "either", F.size("_a") + F.size("_b") - F.col("common"))
    return sized.filter(F.col("common") * 100 >= F.col("either") * percent).drop("_a", "_b")


def candidates(left: DataFrame, right: DataFrame, counts: DataFrame, by: str, percent: int) -> DataFrame:
    """``left_id, right_id``: every pair that can be ``percent`` alike, each once.

    Both sides are ordered by :func:`rarest_first` under ``counts``, which hold the tokens of the right side.
    """
    values = prefixes(right, by, "right_id", percent, "right")
    probes = prefixes(left, by, "left_id", percent, "left")
    met = hot_salted_lookup(values, probes, [by, "token"], "inner", hot=_hot(counts, by))
    return met.filter(may_be_alike(percent)).select("left_id", "right_id").distinct()


def similar_pairs(left: DataFrame, right: DataFrame, counts: DataFrame, by: str, percent: int) -> DataFrame:
    """The pairs whose Jaccard similarity is ``percent`` or more, as ``common`` of ``either`` tokens, with the other
    columns of both sides.

    A set with very many pairs is left to Spark's skew join, as pairs are known only at run time.
    """
    pairs = candidates(left, right, counts, by, percent)
    both = pairs.join(right.withColumnRenamed("tokens", "_b"), "right_id").join(
        left.drop(by).withColumnRenamed("tokens", "_a"), "left_id")
    return compared(both, percent)


def closest_pairs(left: DataFrame, right: DataFrame, counts: DataFrame, by: str, limit: int, percents: list[int],
                  ties: list[Column]) -> DataFrame:
    """The ``limit`` most similar right sets of each left one, of those that reach the last of ``percents``.

    The thresholds fall.  A left set that has ``limit`` pairs at one of them is
    finished, as all it has not met are less alike, so a set with many near
    ones is never compared with its far ones.  ``ties`` orders equal
    similarities.  Columns as :func:`similar_pairs`; stored, one table for each
    threshold.
    """
    order = Window.partitionBy("left_id").orderBy(F.desc(F.col("common") / F.col("either")), *ties)
    found, open_ = [], left
    for k, percent in enumerate(percents):
        ranked = similar_pairs(open_, right, counts, by, percent).withColumn("_rank", F.row_number().over(order))
        best = write_and_read(ranked.filter(F.col("_rank") <= limit), "closest")
        if k + 1 < len(percents):
            full = best.filter(F.col("_rank") == limit).select("left_id")
            best = best.join(full, "left_id", "left_semi")
            open_ = open_.join(full, "left_id", "left_anti")
        found.append(best)
    return union_all(found).drop("_rank")


def closest_in_task(left: pa.ChunkedArray, right: pa.ChunkedArray, limit: int, percent: int) -> list[np.ndarray]:
    """Places of the ``limit`` most similar right sets of each left one, and ``common`` and ``either``, for sets that a task holds.

    The same pairs as :func:`closest_pairs`.  Every shared token is counted, so no set is compared with another; equal
    similarities go by the place on the right.
    """
    def flat(sets: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        lists = sets.combine_chunks()
        return pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)

    (asked, rows), (held, at) = flat(left), flat(right)
    codes = pa.concat_arrays([asked, held]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    asked, held = codes[:len(rows)], codes[len(rows):]
    order = np.argsort(held, kind="stable")
    held, at = held[order], at[order].astype(np.int64)
    first = np.searchsorted(held, asked, "left")
    shared = np.searchsorted(held, asked, "right") - first
    a, b = np.bincount(rows, minlength=len(left)), np.bincount(at, minlength=len(right))
    # Runs of left sets with about MEETINGS shared tokens each.
    before = np.cumsum(shared) - shared
    starts = np.searchsorted(rows, np.arange(len(left)))
    run = before[np.minimum(starts, max(len(before) - 1, 0))] // MEETINGS if len(before) else np.zeros(len(left), dtype=np.int64)
    found = [[np.zeros(0, dtype=np.int64)] * 4]
    for sets in np.split(np.arange(len(left)), np.flatnonzero(np.diff(run)) + 1) if len(left) and len(right) else []:
        low, high = sets[0], sets[-1] + 1
        each = np.arange(np.searchsorted(rows, low), np.searchsorted(rows, high))
        n = shared[each]
        places = np.arange(n.sum()) + np.repeat(first[each] - (np.cumsum(n) - n), n)
        met = np.repeat(rows[each] - low, n) * len(right) + at[places]
        counted = np.bincount(met, minlength=(high - low) * len(right))
        pairs = np.flatnonzero(counted)
        x, y, common = pairs // len(right) + low, pairs % len(right), counted[pairs]
        either = a[x] + b[y] - common
        near = common * 100 >= either * percent
        x, y, common, either = x[near], y[near], common[near], either[near]
        best = np.lexsort((y, -(common / either), x))
        x, y, common, either = x[best], y[best], common[best], either[best]
        kept = np.arange(len(x)) - np.searchsorted(x, x) < limit
        found.append([x[kept], y[kept], common[kept], either[kept]])
    return [np.concatenate(parts) for parts in zip(*found)]
