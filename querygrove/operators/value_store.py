"""An index of values that grows by batches and is probed where it lies.

Two tables, bucketed so that a join with either does not shuffle it: the values
with their shingles, by identity, and the postings, one for each token of a
value's prefix, by database, token and part.  Parts spread the values of a
common token; a probe asks all of them.  The order of tokens is frozen at the
first batch: prefixes are exact under any order that both sides share, and
tokens unknown to it count as the rarest, so a later batch costs speed at most.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import minhash
from . import setjoin
from .linking import identity
from .profiling import COLUMN

BUCKETS = 64
PARTS = 8
#: The least similarity, in percent, that a store can be probed for.
LEAST_PERCENT = 45

VALUES = "right_id STRING, db_id STRING, table_name STRING, column_name STRING, value STRING, tokens ARRAY<STRING>"
POSTINGS = "db_id STRING, token STRING, part INT, right_at INT, right_size INT, right_id STRING"
VALUE_KEY, POSTING_KEY = ["right_id"], ["db_id", "token", "part"]


class Store(NamedTuple):
    """Where a store lies and how it was laid out; :func:`opened` reads it back."""

    spark: SparkSession
    path: str
    buckets: int
    parts: int
    percent: int

    def _table(self, kind: str, schema: str, keys: list[str]) -> str:
        name = f"value_store_{hashlib.md5(self.path.encode()).hexdigest()}_{kind}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({', '.join(keys)}) "
                       f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{kind}'")
        return name

    def values(self) -> str:
        return self._table("values", VALUES, VALUE_KEY)

    def postings(self) -> str:
        return self._table("postings", POSTINGS, POSTING_KEY)

    def order(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/order")


def _sets(values: DataFrame) -> DataFrame:
    """``values`` (COLUMN, value), each once, with identity and tokens; a null value is none."""
    return values.filter(F.col("value").isNotNull()).select(*COLUMN, "value").distinct().select(
        "db_id", identity(*COLUMN, "value").alias("right_id"), "table_name", "column_name", "value",
        minhash.shingles(F.col("value")).alias("tokens"))


def created(values: DataFrame, path: str, percent: int = LEAST_PERCENT, buckets: int = BUCKETS, parts: int = PARTS) -> Store:
    """A new store under ``path``, in a folder that all executors see, with its first batch.

    ``values`` are read twice and should be a stored frame.
    """
    spark = values.sparkSession
    spark.createDataFrame([(buckets, parts, percent)], "buckets int, parts int, percent int").write.parquet(f"{path}/layout")
    setjoin.token_counts(_sets(values), "db_id").write.parquet(f"{path}/order")
    store = Store(spark, path, buckets, parts, percent)
    merge(store, values)
    return store


def opened(spark: SparkSession, path: str) -> Store:
    layout = spark.read.parquet(f"{path}/layout").first()  # one row
    return Store(spark, path, layout.buckets, layout.parts, layout.percent)


def merge(store: Store, values: DataFrame) -> None:
    """Adds the values that the store lacks, with at most one file a bucket and table.

    A batch may be given again, after a failure too: postings are written
    first, and those of a value that is not yet there are only met twice.
    """
    new = _sets(values).join(store.spark.table(store.values()).select("right_id"), "right_id", "left_anti")
    ordered = setjoin.rarest_first(new, store.order(), "db_id", "right_id")
    part = F.pmod(F.xxhash64("right_id"), F.lit(store.parts)).cast("int").alias("part")
    postings = setjoin.prefixes(ordered, "db_id", "right_id", store.percent, "right").select(
        "db_id", "token", part, "right_at", "right_size", "right_id")
    _append(store, postings, store.postings(), POSTING_KEY)
    _append(store, ordered.select("right_id", *COLUMN, "value", "tokens"), store.values(), VALUE_KEY)


def _append(store: Store, rows: DataFrame, table: str, keys: list[str]) -> None:
    # The shuffle and the buckets hash alike, so each task has one bucket.
    rows.repartition(store.buckets, *keys).write.insertInto(table)


def compacted(store: Store, path: str) -> Store:
    """The same store under a new path, one file a bucket and table; the old one stays as it is."""
    into = Store(store.spark, path, store.buckets, store.parts, store.percent)
    store.order().write.parquet(f"{path}/order")
    _append(into, store.spark.table(store.postings()).distinct(), into.postings(), POSTING_KEY)
    _append(into, store.spark.table(store.values()), into.values(), VALUE_KEY)
    store.spark.read.parquet(f"{store.path}/layout").write.parquet(f"{path}/layout")
    return into


def near(store: Store, probes: DataFrame, percent: int) -> DataFrame:
    """``db_id, substring, table_name, column_name, value, jaccard``: all stored values that are ``percent`` like a probe.

    Exact, for ``percent`` from the store's own upwards.  Only probes and pairs
    are shuffled.
    """
    if percent < store.percent:
        raise ValueError(f"the store was laid out for {store.percent} percent and more")
    asked = probes.filter(F.col("substring").isNotNull()).select("db_id", "substring").distinct().select(
        "db_id", identity("db_id", "substring").alias("left_id"), "substring",
        minhash.shingles(F.col("substring")).alias("tokens"))
    left = setjoin.rarest_first(asked, store.order(), "db_id", "left_id")
    every = F.explode(F.sequence(F.lit(0), F.lit(store.parts - 1))).alias("part")
    heads = setjoin.prefixes(left, "db_id", "left_id", percent, "left").select("*", every)
    # A place beyond the prefix for ``percent`` belongs to a lower similarity.
    met = store.spark.table(store.postings()).join(heads, POSTING_KEY).filter(
        (F.col("right_at") <= F.col("right_size") - setjoin.least(percent, F.col("right_size"))) & setjoin.may_be_alike(percent))
    pairs = met.select("left_id", "right_id").distinct()
    both = (pairs.join(store.spark.table(store.values()).withColumnRenamed("tokens", "_b"), "right_id")
            .join(left.drop("db_id").withColumnRenamed("tokens", "_a"), "left_id"))
    return setjoin.compared(both, percent).select(
        "db_id", "substring", "table_name", "column_name", "value", (F.col("common") / F.col("either")).alias("jaccard"))
