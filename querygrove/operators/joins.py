"""Lookups that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT_BUCKETS = 8
# A key is hot when it holds more than one part in this many of the rows, so
# there are never more hot keys than this.
HOT_PARTS = 1024


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _spreading_salt(facts: DataFrame, keys: list[str], salts: int | Column):
    """A salt from the rest of the row: the same after a retry."""
    rest = [F.col(f"`{c}`") for c in facts.columns if c not in keys]
    return F.pmod(F.xxhash64(*(rest or [F.lit(0)])), salts if isinstance(salts, Column) else F.lit(salts)).cast("int")


def salted_lookup(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left",
                  salts: int = SALT_BUCKETS, strategy: str | None = None) -> DataFrame:
    """Join rows with a small lookup side, salting every key.

    The fact rows of one key are spread over ``salts`` partitions and the
    lookup rows are repeated once per salt, so a key with a third of all rows
    is shared by many tasks.  No side is broadcast by hint: Spark does so by
    itself where the size allows.  ``strategy="merge"`` rules it out, for a
    lookup made by ``explode``, whose size Spark underrates before it runs.
    """
    repeated = lookup.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    if strategy:
        repeated = repeated.hint(strategy)
    joined = facts.withColumn("_salt", _spreading_salt(facts, keys, salts)).join(repeated, [*keys, "_salt"], how)
    return joined.drop("_salt")


def hot_keys(facts: DataFrame, keys: list[str]) -> DataFrame:
    """``_key, _salts``: digests of the keys that hold more than their part of the rows, and that many parts.

    At most ``HOT_PARTS`` rows, and as many salts together, whatever the size of ``facts``.
    """
    return hot_counted(facts.groupBy(F.xxhash64(*keys).alias("_key")).agg(F.count(F.lit(1)).alias("_n")), None, "_n")


def hot_counted(counts: DataFrame, keys: list[str] | None, count: str) -> DataFrame:
    """:func:`hot_keys` of rows that are counted already, one row a key; without ``keys`` by its digest ``_key``."""
    total = counts.agg(F.sum(count).alias("_total")).scalar()
    parts = F.ceil(F.col(count) * HOT_PARTS / total).cast("int")
    key = F.xxhash64(*keys).alias("_key") if keys else F.col("_key")
    return counts.filter(F.col(count) * HOT_PARTS > total).select(key, parts.alias("_salts"))


def hot_salted_lookup(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left",
                      hot: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Join rows with a lookup side that may be as large, salting hot keys only.

    A hot key has a salt for each ``HOT_PARTS``-th of the rows that it holds.

    One narrow pass counts the keys by digest, unless ``hot`` brings the result
    of :func:`hot_keys` along.  The facts should be cheap to read twice, as a
    stored table is.  Only the lookup rows of hot keys are repeated.  ``tasks``
    deals both sides to that many tasks, for rows that a session's shuffle
    partitions are too few for.
    """
    hot = F.broadcast(hot if hot is not None else hot_keys(facts, keys))  # at most HOT_PARTS rows

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("_key", F.xxhash64(*keys)).join(hot, "_key", "left").drop("_key")

    left = marked(facts).withColumn("_salt", F.when(F.col("_salts").isNotNull(), _spreading_salt(
        facts, keys, F.col("_salts"))).otherwise(F.lit(0))).drop("_salts")
    copies = F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))
    right = marked(lookup).withColumn("_salt", F.explode(copies)).drop("_salts")
    if tasks:
        left, right = (side.repartition(tasks, *keys, "_salt") for side in (left, right))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions, for a step that costs more time than
    bytes: a partition count given here is not merged at run time.

    Dealt by a digest of the keys: Spark drops a deal by the very keys that the
    rows come dealt by, and with it the count."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, F.xxhash64(*keys))
