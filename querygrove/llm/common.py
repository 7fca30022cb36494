"""Helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querygrove.session import write_and_read

SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def held_out(doc_id) -> Column:
    """True for rows that no model may learn from: crc32 of the id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    t = F.coalesce(text, F.lit(""))
    for blank in "\t\n\x0b\x0c\r":  # plain replacements and a plain split are several times as fast as a pattern
        t = F.replace(t, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(t, " "), "")


def below_share(rows: DataFrame, by: str, digest: Column, limit: int) -> DataFrame:
    """The rows of least ``digest`` (64 bits) in each group, about twice ``limit`` digests of them.

    A first pass counts the digests of each group, copies once, so that what
    goes on to be ranked stays bounded however many rows and tasks there are.
    Groups of few digests stay whole, however many copies they hold.
    """
    # Stored: the planner then knows how few groups there are and need not shuffle the rows for the join.
    each = rows.select(by, digest.alias("_digest")).distinct()
    share = write_and_read(each.groupBy(by).agg(((2.0 * limit + 100) / F.count("*")).alias("_share")), "shares")
    return rows.join(share, by).filter(digest.cast("double") / 2.0 ** 64 + 0.5 <= F.col("_share")).drop("_share")


def groups_of(batches, keys):
    """Arrow batches of a key-sorted partition, regrouped so that no key is split.

    Holds one batch and the rows of the key at its end; the caller keeps keys bounded.
    """
    import pyarrow as pa
    import numpy as np

    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table])
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(change)
        if len(cuts):
            yield table.slice(0, cuts[-1]).combine_chunks()
            table = table.slice(cuts[-1])
        kept = table
    if kept is not None:
        yield kept.combine_chunks()
