"""SimHash near-duplicates: exact pairs by vantage-point trees.

Distinct fingerprints are dealt into shards.  A pair at most ``max_bits`` apart
agrees on some choice of m - max_bits of m bit blocks, so a shard is the ball of
radius zero around one value of such a choice; m follows the number of
fingerprints so that shards stay small (alone, a tree over 64 random bits
prunes next to nothing at radius 4).  Shards above ``shard_rows`` are split by
vantage points in rounds of Spark jobs, and each task builds the rest of the
tree: points go to the inside or outside of the median distance, and those
within ``max_bits`` of that boundary also query the other side.  Links leave a
task as a spanning star of each local group, never as all pairs.

Null and empty texts have fingerprint zero, linked like any other.  Rows that
share an id are independent rows; a null id never names a component unless all
ids of it are null.  An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygrove.operators.joins import hot_salted_lookup
from querygrove.session import write_and_read

from .common import groups_of
from .components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LEAF, SHARD_ROWS, ROUNDS, SHRINK = 64, 20_000, 40, 0.8


def fingerprint(text: str | None, n: int) -> int:
    """Bits set in more than half of the hashes of the n-word shingles."""
    tokens = (text or "").encode().translate(LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if len(tokens) > n:
        starts, ends = starts[:len(tokens) - n + 1], ends[n - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    votes = np.zeros(64, np.int64)
    for k in range(0, len(h), 65_536):
        part = h[k:k + 65_536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", doc_id: str = "doc_id",
                 numbers: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, fp) of every row; fp is the signed long of the 64 bits.  ``numbers`` come along as k0, k1 and so on."""
    names = ["doc_id", "fp", *[f"k{i}" for i in range(len(numbers))]]

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=names)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       *[n.cast("long") for n in numbers])
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _blocks(n: int, max_bits: int) -> int:
    """The number of bit blocks with the least work: rows dealt, and pairs compared at 1/500 of a row each."""
    def cost(m):
        bits = 64 * (m - max_bits) // m
        return comb(m, max_bits) * n * (1 + n / 2 ** bits / 500)
    return min(range(max_bits + 1, max_bits + 6), key=cost)


def _dealt(fps: DataFrame, m: int, max_bits: int) -> DataFrame:
    """(shard, fp) for every choice of blocks that may agree."""
    edges = [64 * k // m for k in range(m + 1)]
    shards = []
    for no, chosen in enumerate(combinations(range(m), m - max_bits)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        shards.append(F.xxhash64(F.lit(no), F.col("fp").bitwiseAND(F.lit(signed).cast("long"))))
    return fps.select(F.explode(F.array(*shards)).alias("shard"), "fp", F.lit(True).alias("home"))


def _split(rows: DataFrame, max_bits: int, limit: int) -> DataFrame:
    """Splits shards above ``limit`` at vantage points, with overlapping queries, as long as that helps.

    A part of more than ``SHRINK`` of what was split (a dense ball) goes to its task as it is.
    """
    done = []
    rows = rows.withColumn("before", F.lit(1 << 62))
    for _ in range(ROUNDS):
        large = write_and_read(rows.groupBy("shard").agg(
            F.count("*").alias("n"), F.min_by("fp", F.struct(F.xxhash64("fp"), "fp")).alias("v"))
            .join(rows.groupBy("shard").agg(F.max("before").alias("was")), "shard")
            .filter((F.col("n") > limit) & (F.col("n") <= F.col("was") * SHRINK)).drop("was"), "vantage")
        if large.isEmpty():
            break
        done.append(rows.join(large, "shard", "left_anti"))
        d = rows.join(large, "shard").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))))
        d = write_and_read(d, "vantage")
        counts = d.groupBy("shard", "d").agg(F.count("*").alias("c"))
        radius = counts.selectExpr("shard", "d", "sum(c) OVER (PARTITION BY shard ORDER BY d) AS upto",
                                   "sum(c) OVER (PARTITION BY shard) AS n", "max(d) OVER (PARTITION BY shard) AS most")
        radius = radius.filter("2 * upto >= n OR d = most").groupBy("shard").agg(
            F.least(F.min("d"), F.max("most") - 1).alias("r"))
        at = d.join(radius, "shard")
        sides = F.array(
            F.when((F.col("d") <= F.col("r")) | (~F.col("home") & (F.col("d") <= F.col("r") + max_bits)),
                   F.struct(F.xxhash64("shard", F.lit(0)).alias("shard"), F.col("home").alias("home"))),
            F.when(F.col("d") > F.col("r") - max_bits,
                   F.struct(F.xxhash64("shard", F.lit(1)).alias("shard"),
                            (F.col("home") & (F.col("d") > F.col("r"))).alias("home"))))
        rows = write_and_read(at.select("fp", "n", F.explode(sides).alias("s")).filter("s IS NOT NULL").select(
            "s.shard", "fp", "s.home", F.col("n").alias("before")), "vantage")
    return _union([*done, rows]).drop("before")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def tree_links(points: np.ndarray, queries: np.ndarray, max_bits: int):
    """Index pairs at most ``max_bits`` apart: points among themselves, then queries against points.

    Yields arrays (i, j); indices at or above len(points) are queries.
    """
    everything = np.concatenate([points, queries])
    stack = [(np.arange(len(points)), np.arange(len(points), len(everything)))]
    while stack:
        own, asking = stack.pop()
        if not len(own):
            continue
        if len(own) > LEAF:
            v = everything[own[0]]
            d, dq = np.bitwise_count(everything[own] ^ v), np.bitwise_count(everything[asking] ^ v)
            r = min(int(np.median(d)), int(d.max()) - 1)
            if r >= 0 and (d > r).any() and (d <= r).any():
                d, dq = d.astype(np.int64), dq.astype(np.int64)
                stack.append((own[d <= r], asking[dq <= r + max_bits]))
                stack.append((own[d > r], np.concatenate([asking[dq > r - max_bits],
                                                          own[(d <= r) & (d > r - max_bits)]])))
                continue
        for k in range(0, len(own), LEAF):
            some = own[k:k + LEAF]
            rest = np.concatenate([own[k:], asking])
            i, j = np.nonzero(np.bitwise_count(everything[some][:, None] ^ everything[rest][None, :]) <= max_bits)
            apart = some[i] != rest[j]
            yield some[i][apart], rest[j][apart]


def _stars(points: np.ndarray, queries: np.ndarray, max_bits: int):
    """Spanning stars (indices) of the groups that links join."""
    parent = np.arange(len(points) + len(queries))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    touched = set()
    for i, j in tree_links(points, queries, max_bits):
        for a, b in zip(i.tolist(), j.tolist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                touched.update((a, b))
    return [(find(x), x) for x in touched if find(x) != x]


def links(fps: DataFrame, max_bits: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs at most ``max_bits`` apart.

    ``fps`` is a stored table of distinct fingerprints (fp).
    """
    dealt = _split(_dealt(fps, _blocks(max(1, fps.count()), max_bits), max_bits), max_bits, shard_rows)

    def run(batches):
        for t in groups_of(batches, ["shard"]):
            shard, fp, home = (t.column(c).to_numpy() for c in ("shard", "fp", "home"))
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            fp = fp.view(np.uint64)
            a, b = [], []
            sizes = np.diff(cuts)
            small = sizes <= LEAF
            # Leaves of one step: all rows k places apart in the same shard.
            of = np.repeat(np.where(small, np.arange(len(sizes)), -1), sizes)
            for k in range(1, int(sizes[small].max(initial=1))):
                near = np.flatnonzero((of[k:] == of[:-k]) & (of[k:] >= 0) & (home[k:] | home[:-k])
                                      & (np.bitwise_count(fp[k:] ^ fp[:-k]) <= max_bits))
                a.append(fp[near])
                b.append(fp[near + k])
            for s, e in zip(cuts[:-1][~small], cuts[1:][~small]):
                own, asking = fp[s:e][home[s:e]], fp[s:e][~home[s:e]]
                both = np.concatenate([own, asking])
                if star := _stars(own, asking, max_bits):
                    x, y = np.array(star).T
                    a.append(both[x])
                    b.append(both[y])
            x = np.concatenate(a or [fp[:0]]).view(np.int64)
            y = np.concatenate(b or [fp[:0]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded = dealt.repartition(parts, "shard").sortWithinPartitions("shard", F.desc("home"))
    return sharded.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    rows = write_and_read(fingerprints(docs, shingle), "fingerprints")
    distinct = write_and_read(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), max_bits, shard_rows)).withColumnRenamed("node", "fp")
    linked = distinct.join(roots, "fp")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    all_names = distinct.join(roots.join(named, "root").select("fp", "component_id"), "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id"))
    return hot_salted_lookup(rows, all_names, ["fp"], "inner").select("doc_id", "fp", "component_id")


def kept_of_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of each component: that with the smallest id, null ids last.

    Rows that share an id are told apart by digests of their text and of the
    whole row, so none stands for another; of rows that are equal in every
    column one stays.
    """
    numbers = (F.xxhash64("text"), F.xxhash64(F.lit(7), "text"), F.xxhash64(F.to_json(F.struct(*[docs[c] for c in docs.columns]))))
    key = ["doc_id", "k0", "k1", "k2"]
    rows = write_and_read(fingerprints(docs, shingle, numbers=numbers), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("last"), *key)
    best = write_and_read(rows.groupBy("fp").agg(F.min(order).alias("best")), "distinct")
    roots = components(links(best.select("fp"), max_bits, SHARD_ROWS)).withColumnRenamed("node", "fp")
    kept = best.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(
        F.min("best").alias("best")).select(*[F.col(f"best.{c}").alias(f"_{c}") for c in key])
    marked = docs.select("*", *[n.alias(f"_own{i}") for i, n in enumerate(numbers)])
    same = marked["doc_id"].cast("long").eqNullSafe(kept["_doc_id"])
    for i in range(len(numbers)):
        same = same & (marked[f"_own{i}"] == kept[f"_k{i}"])
    chosen = marked.join(kept, same, "left_semi")
    return chosen.dropDuplicates(["doc_id", *[f"_own{i}" for i in range(len(numbers))]]).select(*docs.columns)
