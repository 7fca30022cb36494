"""Reading large JSON arrays in many tasks.

Spark reads an array file as one record, in one task.  Here a file is cut at
every closing brace, which its text reader can do from any byte, so a file is
as many blocks as its size asks for.  Whether a brace stands inside a string
and how deep it is nested depends on all that came before; a first pass sums
that up for each block, for both cases of a string being open at its start, and
the sums put together give every block the state that it starts in.  In the
second pass each block finds its records; one that crosses the edge of a block
is put together from the pieces that its blocks hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUMMARY = "file string, block long, opens string, quotes long, outside long, inside long"
PIECE = "file string, block long, kind int, text string"
RECORD, TAIL, REST = 0, 1, 2  # a whole record, the start of one, what goes on or ends one


def _pieces(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """``value, file, block``: what stands before each closing brace, in the order of a block."""
    reader = spark.read.option("lineSep", "}")
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                    F.col("_metadata.file_block_start").alias("block"))


def scan(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """At each byte: the quotes up to it, and what a bracket there does to the depth."""
    text = np.frombuffer(raw, np.uint8)
    quote, back = text == ord('"'), text == ord("\\")
    if back.any():
        place = np.arange(len(text))
        plain = np.maximum.accumulate(np.where(back, -1, place))
        odd = (place - plain) & 1  # ends a run of backslashes of odd length
        quote[1:] &= odd[:-1] == 0
    step = ((text == ord("{")) | (text == ord("["))).astype(np.int8) - ((text == ord("}")) | (text == ord("]")))
    return np.cumsum(quote), step


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[tuple, bytes]]:
    """The text of each block in a batch, with the block's other columns."""
    if not batch.num_rows:
        return
    values = batch.column(0).to_pylist()
    block = batch.column(2).to_numpy()
    file = batch.column(1).dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (file[1:] != file[:-1]), True])
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield tuple(c[s].as_py() for c in batch.columns[1:]), ("}".join(values[s:e]) + "}").encode()


def _summaries(batches):
    """One SUMMARY row for each block."""
    key, total = None, None
    for batch in batches:
        out = []
        for now, raw in _chunks(batch):
            if now != key:
                if key:
                    out.append((*key, *total))
                key, total = now, (raw.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("utf-8", "replace"), 0, 0, 0)
            quotes, step = scan(raw)
            opens, before, outside, inside = total
            odd = quotes & 1 == 1
            sums = int(step[~odd].sum()), int(step[odd].sum())
            total = opens, before + int(quotes[-1]), outside + sums[before & 1], inside + sums[1 - (before & 1)]
        if out:
            yield _batch(out, SUMMARY)
    if key:
        yield _batch([(*key, *total)], SUMMARY)


def _batch(rows: list[tuple], shape: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in shape.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)],
                                      names=[n for n, _ in fields])


def _states(summaries: DataFrame) -> DataFrame:
    """``file, block, base, depth, quoted``: where each block starts, and the depth between records of its file.

    A file has a row for each block, so what is gathered is one row for many megabytes.
    """
    def step(state: Column, x: Column) -> Column:
        change = F.when(state["quoted"], x["inside"]).otherwise(x["outside"])
        return F.struct(
            (state["depth"] + change).alias("depth"),
            (state["quoted"] != (x["quotes"] % 2 == 1)).alias("quoted"),
            F.array_append(state["starts"], F.struct(x["block"].alias("block"), state["depth"].alias("depth"),
                                                     state["quoted"].alias("quoted"))).alias("starts"))
    zero = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(False).alias("quoted"),
                    F.array().cast("array<struct<block:bigint,depth:bigint,quoted:boolean>>").alias("starts"))
    listed = F.array_sort(F.collect_list(F.struct("block", "quotes", "outside", "inside")))
    base = F.when(F.min_by("opens", "block") == "[", 1).otherwise(0)
    return summaries.groupBy("file").agg(base.alias("base"), F.aggregate(listed, zero, step)["starts"].alias("starts")).select(
        "file", "base", F.inline("starts"))


def _records(batches):
    """Whole records of each block, and the pieces of those that cross its edges."""
    key, held, middle, depth, quoted = None, b"", False, 0, 0
    for batch in batches:
        out: list[tuple] = []
        for (file, block, base, start, open_string), raw in _chunks(batch):
            if key != (file, block):
                if held:
                    out.append((*key, REST if middle else TAIL, held.decode()))
                # A block that starts inside of a record ends that one first.
                key, held, middle, depth, quoted = (file, block), b"", start > base, start, int(open_string)
            quotes, step = scan(raw)
            outside = (quotes + quoted) & 1 == 0
            levels = depth + np.cumsum(np.where(outside, step, 0))
            text = np.frombuffer(raw, np.uint8)
            begins = np.flatnonzero((text == ord("{")) & outside & (levels == base + 1))
            ends = np.flatnonzero((text == ord("}")) & outside & (levels == base)) + 1
            depth, quoted = int(levels[-1]), (quoted + int(quotes[-1])) & 1
            at, within = 0, bool(held) or middle
            for end in ends.tolist():
                if not within:
                    at = int(begins[np.searchsorted(begins, at)])
                out.append((*key, REST if middle else RECORD, (held + raw[at:end]).decode()))
                at, held, middle, within = end, b"", False, False
            if within:
                held += raw[at:]
            elif depth > base and (k := np.searchsorted(begins, at)) < len(begins):
                held = raw[int(begins[k]):]
        if out:
            yield _batch(out, PIECE)
    if held:
        yield _batch([(*key, REST if middle else TAIL, held.decode())], PIECE)


def read_array(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """The objects of JSON arrays under ``path`` as rows of ``schema``, with ``file``.

    Files of single objects, one after another, are read too.  Values of an
    array that are no objects are left out, as is what stands behind a broken
    bracket.  The size of a block is ``spark.sql.files.maxPartitionBytes``.
    """
    pieces = _pieces(spark, path, options)
    states = _states(pieces.mapInArrow(_summaries, SUMMARY))
    # One row for each block: a millionth of the input and less.
    placed = pieces.join(F.broadcast(states), ["file", "block"]).select("value", "file", "block", "base", "depth", "quoted")
    found = placed.mapInArrow(_records, PIECE)
    parts = found.filter(F.col("kind") != RECORD)
    in_file = Window.partitionBy("file").orderBy("block", F.desc("kind"))  # two rows for each block at most
    crossing = parts.withColumn("record", F.count_if(F.col("kind") == TAIL).over(in_file)).groupBy("file", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", (-F.col("kind")).alias("k"), "text"))),
                                 lambda x: x["text"]), "").alias("text"))
    texts = found.filter(F.col("kind") == RECORD).select("file", "text").unionByName(crossing.select("file", "text"))
    return texts.select("file", F.from_json("text", schema).alias("r")).select("r.*", "file")
