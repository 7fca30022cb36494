"""The prefix trie of conversations: what they share, and what sharing saves.

Conversations are paths of turns.  Each task puts its share of them, in
batches, into a z-fast trie (:mod:`.ztrie`) and expands its edges to one row a
node, so nodes meet in the shuffle once a task and not once a conversation, and
rows of a prefix that a third of all conversations have are few.  A node is
named by its depth and 128 bits that every turn above it adds to.  A long
conversation is a chain of segments, each a path of its own from the node where
the one before ended; the tries take any cut of the conversations.

A first pass gives members, least members and parents.  Sums over subtrees come
from a second: each node's own share is given to its least member, whose path
carries it upwards.

``conversations`` has conv_id, turn, role and text, and may have more columns.
Null roles and texts are empty.  Rows without a conv_id belong to no
conversation.  Null turns come first; turns of equal number go by role, then by
a digest of role and text; repeated rows are turns of their own.  Texts are
digested whole.  Without conversations there are no rows, not even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querygrove.operators.joins import hot_salted_lookup
from querygrove.session import write_and_read

from .common import groups_of
from .rows import digests, partitions, placed, spans
from .ztrie import Path, ZFastTrie

SEGMENT, HELD, BATCH, CHUNK = 256, 200_000, 4_096, 65_536
FAMILY, LENGTHS = 5, 9  # conversations of one base, and the range of borrowed prefixes
NODE = ("kind int, depth long, a long, b long, above_a long, above_b long, n long, conv_id long, bytes long, "
        "leaves long, saved long")
KEY = ["depth", "a", "b"]


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % LENGTHS


def family(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``turns`` (conv_id, depth, y1, y2, bytes, total) and ``convs`` (conv_id, total), both stored.

    Each conversation starts with the first turns of its family's first one, then has its own turns after as many.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), *digests(role, text),
        F.octet_length(text).cast("long").alias("bytes"))
    stored = placed(rows)
    parts = spans(stored)
    h = borrowed(F.col("conv_id"))
    sizes = parts.select("conv_id", "n").distinct()
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least(h, F.coalesce("base_n", F.lit(0)))
    convs = write_and_read(sizes.withColumn("base", family(F.col("conv_id"))).join(bases, "base", "left").select(
        "conv_id", taken.alias("taken"), (taken + F.greatest(F.col("n") - h, F.lit(0))).alias("total")), "convs")
    # A conversation has one row for each pid in ``parts``, so no pid meets more rows than it holds.
    known = stored.join(parts.join(convs, "conv_id"), ["conv_id", "pid"]).withColumn(
        "rank", F.col("before") + F.col("place"))
    own = known.filter(F.col("rank") > h).select(
        "conv_id", (F.col("taken") + F.col("rank") - h).alias("depth"), "d1", "d2", "bytes", "total")
    near = F.sequence(F.col("conv_id") - (FAMILY - 1), F.col("conv_id") + (FAMILY - 1))
    first = known.filter((F.col("rank") < LENGTHS) & (family(F.col("conv_id")) == F.col("conv_id"))).select(
        F.col("conv_id").alias("base"), F.col("rank").alias("depth"), "d1", "d2", "bytes", F.explode(near).alias("conv_id"))
    given = first.filter((family(F.col("conv_id")) == F.col("base")) & (F.col("depth") <= h)).join(
        convs.select("conv_id", "total"), "conv_id").select("conv_id", "depth", "d1", "d2", "bytes", "total")
    both = own.unionByName(given)
    turns = both.select("conv_id", "depth", F.xxhash64("depth", "d1", "d2").alias("y1"),
                        F.xxhash64("d2", "depth", "d1").alias("y2"), "bytes", "total")
    return write_and_read(turns, "turns"), convs


def _segment(depth: Column) -> Column:
    return F.floor((F.greatest(depth, F.lit(1)) - 1) / SEGMENT)


def _starts(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, seg, total, x1, x2``: the segments of every conversation and the digest each starts with."""
    each = turns.filter(F.col("total") > SEGMENT).groupBy("conv_id", _segment(F.col("depth")).alias("seg")).agg(
        F.bit_xor("y1").alias("y1"), F.bit_xor("y2").alias("y2"))
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    long = each.select("conv_id", "seg", F.bit_xor("y1").over(before).alias("x1"), F.bit_xor("y2").over(before).alias("x2"))
    segs = convs.select("conv_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), _segment(F.col("total")))).alias("seg"))
    return segs.join(long, ["conv_id", "seg"], "left").na.fill(0, ["x1", "x2"])


def _tries(rows: DataFrame) -> DataFrame:
    """NODE rows of kind 0 for the nodes of each task's tries, and of kind 1 for the conversations that end in them.

    ``rows`` are conv_id, seg, kind, depth, u, v, w: a segment's start (digest, total turns), its turns (digest,
    bytes) and weights of its depths (leaves, bytes saved).
    """
    def batch_of(trie, weights):
        nodes, ends = trie.expanded(weights)
        size = len(nodes["a"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(size, np.int32)), *[pa.array(nodes[c]) for c in nodes]], names=["kind", *nodes])
        for at in range(0, len(ends), HELD):
            part = ends[at:at + HELD]
            key = np.frombuffer(b"".join(e[1] for e in part), np.int64).reshape(-1, 2)
            none = np.zeros(len(part), np.int64)
            columns = {"depth": np.array([e[0] for e in part], np.int64), "a": key[:, 0], "b": key[:, 1], "above_a": none,
                       "above_b": none, "n": none, "conv_id": np.array([e[2] for e in part], np.int64), "bytes": none,
                       "leaves": none, "saved": none}
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(part), np.int32)), *map(pa.array, columns.values())],
                                             names=["kind", *columns])

    def run(batches):
        trie, weights, paths = ZFastTrie(), {}, []
        for t in groups_of(batches, ["conv_id", "seg"]):
            conv, seg, kind, depth, u, v, w = (
                t.column(c).to_numpy() for c in ("conv_id", "seg", "kind", "depth", "u", "v", "w"))
            cuts = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (seg[1:] != seg[:-1]), True])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                turns = s + int(np.searchsorted(kind[s:e], 2))
                pair = np.bitwise_xor.accumulate(np.stack([u[s:turns], v[s:turns]], 1), axis=0)
                path = Path(int(depth[s]), pair.tobytes(), w[s + 1:turns].tolist())
                (path.ending if w[s] == path.end else path.passing).append(int(conv[s]))
                paths.append(path)
                for k in range(turns, e):
                    place = weights.setdefault(path.key(int(depth[k])), [0, 0])
                    place[0] += int(u[k])
                    place[1] += int(v[k])
                if len(paths) >= BATCH:
                    trie.insert_batch(paths)
                    paths = []
                    if trie.held >= HELD:
                        yield from batch_of(trie, weights)
                        trie, weights = ZFastTrie(), {}
        trie.insert_batch(paths)
        if trie.roots:
            yield from batch_of(trie, weights)
    dealt = rows.repartition(family(F.col("conv_id")), "seg").sortWithinPartitions("conv_id", "seg", "kind", "depth")
    return dealt.mapInArrow(run, NODE)


def listed_sha256(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by`` and ``sha256`` of the ascending values of a group, in decimal, joined by commas.

    A group may hold any share of the rows: ranges of (by, value) are joined to pieces first, and only pieces meet.
    """
    names = [*by, value]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def pieces(batches):
        pid, piece, key, held, size = TaskContext.get().partitionId(), 0, None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for *now, x in zip(*(batch.column(c).to_pylist() for c in names)):
                if held and (now != key or size >= CHUNK):
                    out.append((*key, pid, piece, ",".join(held)))
                    piece, held, size = piece + 1, [], 0
                key = now
                held.append(str(x))
                size += len(held[-1]) + 1
            if held and out:
                yield from _batch(out, by)
                out = []
        if held:
            out.append((*key, pid, piece, ",".join(held)))
        if out:
            yield from _batch(out, by)

    def hashed(batches):
        key, state, out = None, None, []
        for batch in batches:
            for *now, text in zip(*(batch.column(c).to_pylist() for c in [*by, "text"])):
                if now != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*by, "sha256"])
                out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], names=[*by, "sha256"])
    spread = rows.repartitionByRange(partitions(rows.sparkSession), *names).sortWithinPartitions(*names)
    cut = spread.mapInArrow(pieces, f"{kinds}, pid int, piece int, text string")
    return cut.repartition(*by).sortWithinPartitions(*by, "pid", "piece").mapInArrow(hashed, f"{kinds}, sha256 string")


def _batch(out: list[tuple], by: list[str]):
    columns = list(zip(*out))
    kinds = [pa.int64()] * len(by) + [pa.int32(), pa.int32(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*by, "pid", "piece", "text"])


def trie_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    starts = write_and_read(_starts(turns, convs), "starts")
    zero = F.lit(0).cast("long")
    paths = starts.select("conv_id", "seg", F.lit(0).alias("kind"), (F.col("seg") * SEGMENT).alias("depth"),
                          F.col("x1").alias("u"), F.col("x2").alias("v"), F.col("total").alias("w")).unionByName(
        turns.select("conv_id", _segment(F.col("depth")).alias("seg"), F.lit(1).alias("kind"), "depth",
                     F.col("y1").alias("u"), F.col("y2").alias("v"), F.col("bytes").alias("w")))
    made = write_and_read(_tries(paths).drop("leaves", "saved"), "tries")
    merged = write_and_read(made.filter("kind = 0").groupBy(*KEY).agg(
        F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"),
        F.max("above_a").alias("above_a"), F.max("above_b").alias("above_b")), "nodes")
    children = merged.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above_a").alias("a"),
                                                  F.col("above_b").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = write_and_read(merged.join(children, KEY, "left").na.fill(0, ["n_children"]), "nodes")

    leaf = (F.col("n_children") == 0).cast("long")
    own = nodes.select("conv_id", _segment(F.col("depth")).alias("seg"), "depth", leaf.alias("u"),
                       ((F.col("n_convs") - 1) * F.col("bytes")).alias("v")).filter("u > 0 OR v > 0")
    later = own.filter("seg > 0").groupBy("conv_id", "seg").agg(F.sum("u").alias("u"), F.sum("v").alias("v"))
    above = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    carried = starts.filter(F.col("total") > SEGMENT).select("conv_id", "seg").join(later, ["conv_id", "seg"], "left").select(
        "conv_id", "seg", ((F.col("seg") + 1) * SEGMENT).alias("depth"), F.sum("u").over(above).alias("u"),
        F.sum("v").over(above).alias("v")).filter("u > 0 OR v > 0")
    weights = own.unionByName(carried).withColumn("kind", F.lit(2)).withColumn("w", zero)
    sums = _tries(paths.unionByName(weights)).filter("kind = 0").groupBy(*KEY).agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("above_a"), F.col("b").alias("above_b"),
                           F.col("conv_id").alias("parent_conv_id"))
    placed_ = hot_salted_lookup(nodes, parents, ["depth", "above_a", "above_b"], "left")
    ends = listed_sha256(made.filter("kind = 1").select(*KEY, "conv_id"), KEY, "conv_id")
    # Every frame has a key once, so the joins have no hot key.
    whole = placed_.join(sums, KEY, "left").join(ends, KEY, "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie_of(*rebuilt(conversations))
