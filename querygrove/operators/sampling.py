"""Seeded samples, caps, order and splits.

Each choice depends on a digest of the row's own key, so it is the same for
any number of partitions and after any retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD, seeded_digest, seeded_uint32

UINT32 = 2**32
RANK_BITS = 16


def cap_per_group(rows: DataFrame, group: list[str], keys: list[str], limit: int = 5,
                  seed: int = 42) -> DataFrame:
    """At most ``limit`` rows of each group, picked by digest.

    Spark limits each map task's groups before the shuffle, so a hot group
    sends ``limit`` rows per task.
    """
    order = Window.partitionBy(*group).orderBy(seeded_digest(seed, *[F.col(k) for k in keys]),
                                               *keys)
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit).drop("_rank")


def _ranges(rows: DataFrame, keys: list[str], seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows marked with their digest range, and the rank each range starts at.

    The second frame has at most ``2**16`` rows whatever the size of the first.
    """
    digest = seeded_digest(seed, *[F.col(k) for k in keys])
    number = F.conv(F.substring(digest, 1, RANK_BITS // 4), 16, 10).cast("int")
    marked = rows.withColumn("_digest", digest).withColumn("_range", number)
    counts = marked.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return marked, starts


def ranked(rows: DataFrame, keys: list[str], seed: int = 42, name: str = "shuffle_rank") -> DataFrame:
    """A global random rank from 1, without sorting all rows in one task.

    Digest ranges are ranked apart and then shifted by the counts of the ranges
    before them.  Keys must be unique, as equal keys share a range.
    """
    marked, starts = _ranges(rows, keys, seed)
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_digest", *keys))
    return (marked.join(F.broadcast(starts.drop("_n")), "_range")  # at most 2**16 rows
            .withColumn(name, F.col("_start") + within)
            .drop("_digest", "_range", "_start"))


def shuffled(rows: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Rows in random order: a range-partitioned sort by digest."""
    return rows.orderBy(seeded_digest(seed, *[F.col(k) for k in keys]), *keys)


def sample_fraction(rows: DataFrame, keys: list[str], fraction: float = 0.5, seed: int = 42,
                    exact: bool = True) -> DataFrame:
    """A random share of the rows.

    Exact: the rounded number of rows, halves to even.  The cut-off digest is
    looked up in the one range that holds it, so whole rows are filtered where
    they are and never shuffled.  Otherwise a digest threshold, whose count is
    right on average.
    """
    if not exact:
        return rows.filter(seeded_uint32(seed, *[F.col(k) for k in keys]) < int(fraction * UINT32))
    marked, starts = _ranges(rows.select(*keys), keys, seed)
    total = F.sum("_n").over(Window.partitionBy())
    edge = (starts.withColumn("_left", F.bround(total * F.lit(fraction)).cast("bigint") - F.col("_start"))
            .filter((F.col("_left") > 0) & (F.col("_left") <= F.col("_n"))))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_digest", *keys))
    cut = (marked.join(F.broadcast(edge), "_range")  # one row
           .withColumn("_rank", within).filter(F.col("_rank") == F.col("_left"))
           .select(F.struct("_digest", *keys)))
    digest = seeded_digest(seed, *[F.col(k) for k in keys]).alias("_digest")
    return rows.filter(F.struct(digest, *keys) <= cut.scalar())


def split(rows: DataFrame, keys: list[str], test_share: float = 0.01, seed: int = 42) -> DataFrame:
    """Adds ``split``.  Key it on the question and no question is on both sides;
    key it on the row for a split by row."""
    low = seeded_uint32(seed, *[F.col(k) for k in keys]) < int(test_share * UINT32)
    return rows.withColumn("split", F.when(low, F.lit("validation")).otherwise(F.lit("train")))


def token_estimate(text: Column) -> Column:
    """Words and single other marks: an upper-level count without a model's vocabulary."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"({WORD}|[^\p{{L}}\p{{N}}_\s])"), F.lit(1)))


def short_enough(rows: DataFrame, text: str, max_tokens: int = 2000) -> DataFrame:
    return rows.filter(token_estimate(F.col(text)) <= max_tokens)


def drop_failed(rows: DataFrame, error: str = "error") -> DataFrame:
    """Rows whose processing recorded no error."""
    return rows.filter(F.col(error).isNull()).drop(error)


def failure_counts(rows: DataFrame, error: str = "error") -> DataFrame:
    """How many rows :func:`drop_failed` removes, by error."""
    return rows.filter(F.col(error).isNotNull()).groupBy(error).agg(F.count(F.lit(1)).alias("n_rows"))
