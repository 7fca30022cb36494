"""Rows of many conversations in order, without one task per conversation.

A conversation may hold a large share of all rows, so it is sorted by ranges of
(conv_id, turn, ...) and may span partitions.  Places inside a partition are
counted there; only one number for each conversation and partition goes on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querygrove.session import write_and_read

ORDER = ["conv_id", "turn", "role", "d1", "d2"]


def digests(role: Column, text: Column) -> list[Column]:
    """``d1`` and ``d2``: 128 bits that stand for a turn's role and text."""
    return [F.xxhash64(role, text).alias("d1"), F.xxhash64(F.lit(7), text, role).alias("d2")]


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (ORDER and others), stored, with ``pid``, ``place`` (from 1, in this pid and conversation) and
    ``again`` (the same role and text came before in this pid and conversation)."""
    def run(batches):
        pid = TaskContext.get().partitionId()
        conv, count, seen = None, 0, set()
        for batch in batches:
            place, again = [], []
            for c, a, b in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "d1", "d2"))):
                if c != conv:
                    conv, count, seen = c, 0, set()
                count += 1
                place.append(count)
                again.append((a, b) in seen)
                seen.add((a, b))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(place), pid), pa.int32()), pa.array(place, pa.int64()),
                 pa.array(again, pa.bool_())], names=[*batch.schema.names, "pid", "place", "again"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *ORDER).sortWithinPartitions(*ORDER)
    return write_and_read(dealt.mapInArrow(run, f"{kinds}, pid int, place long, again boolean"), "placed")


def spans(stored: DataFrame) -> DataFrame:
    """``conv_id, pid, before, n``: rows of a conversation in lower pids, and in all; stored."""
    counts = stored.groupBy("conv_id", "pid").agg(F.count("*").alias("k"))
    own = Window.partitionBy("conv_id")  # one row for each pid at most
    return write_and_read(counts.select(
        "conv_id", "pid", (F.sum("k").over(own.orderBy("pid")) - F.col("k")).alias("before"),
        F.sum("k").over(own).alias("n")), "spans")
