"""Best-fit packing with conflicts: bins carry source and duplicate-cluster bitmaps.

Texts are cut into pieces of at most ``capacity`` tokens (words).  A full piece
is a bin of its own.  The others are dealt evenly by hash into shards of about
``shard_rows`` pieces; in a shard they go in order of falling length to the open
bin with the least room that still fits and holds no piece of the same source
or duplicate cluster: bins are kept by room, and the search goes on to the next
larger room until a compatible bin is found, else a new bin opens.  Among bins
of the same room the one opened first is taken; equal pieces go by id, start,
source and cluster.

Null sources are one source; rows that share an id are pieces of their own.
Texts without words give no piece.  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querygrove.session import write_and_read

from .common import groups_of, words

CAPACITY, SHARD_ROWS = 2048, 20_000
PACKED = "shard long, doc_id long, source string, start long, n long, bin long"


def best_fit(pieces, capacity: int) -> list[int]:
    """The bin of each piece (length, source bit, cluster bit), in the order given."""
    rooms: list[int] = []                       # rooms of open bins, sorted, each once
    open_bins: dict[int, dict[int, list]] = {}  # room -> sources -> bins (clusters, number), by number
    out, made = [], 0
    for n, source, cluster in pieces:
        k, chosen = bisect_left(rooms, n), None
        while k < len(rooms) and chosen is None:
            room = rooms[k]
            for sources, bins in open_bins[room].items():
                if sources & source:
                    continue
                free = next((b for b in bins if not b[0] & cluster), None)
                if free and (chosen is None or free[1] < chosen[1][1]):
                    chosen = sources, free
            k += 1
        if chosen is None:
            sources, clusters, number, room = 0, 0, made, capacity
            made += 1
        else:
            (sources, (clusters, number)) = chosen
            same = open_bins[room][sources]
            same.remove(chosen[1])
            if not same:
                del open_bins[room][sources]
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(bisect_left(rooms, room))
        out.append(number)
        room -= n
        if room:
            if room not in open_bins:
                open_bins[room] = {}
                insort(rooms, room)
            insort(open_bins[room].setdefault(sources | source, []), (clusters | cluster, number), key=lambda b: b[1])
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: doc_id, source, start and n_tokens (in words), bin_id, bin_tokens.

    Copies (texts of the same words in lower case) are one duplicate cluster.
    """
    spark = docs.sparkSession
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                         words(F.lower("text")).alias("w"))
    pieces = write_and_read(tokens.select(
        "doc_id", "source", F.xxhash64("w").alias("cluster"), F.size("w").cast("long").alias("size")
    ).filter("size > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1,
                                                          F.lit(capacity).cast("long"))).alias("start")).select(
        "doc_id", "source", "cluster", "start", F.least(F.col("size") - F.col("start"), F.lit(capacity)).alias("n")),
        "pieces")
    full = pieces.filter(F.col("n") == capacity)
    rest = pieces.filter(F.col("n") < capacity)
    shards = max(1, -(-rest.count() // shard_rows))
    parts = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "start"), F.lit(shards)))

    def run(batches):
        for t in groups_of(batches, ["shard"]):
            shard = t.column("shard").to_pylist()
            source, cluster, n = (t.column(c).to_pylist() for c in ("source", "cluster", "n"))
            bins, s = [], 0
            for e in range(1, len(shard) + 1):
                if e < len(shard) and shard[e] == shard[s]:
                    continue
                bit: dict = {}
                counts: dict = {}
                for c in cluster[s:e]:
                    counts[c] = counts.get(c, 0) + 1
                repeated = {c: 1 << k for k, c in enumerate(c for c in counts if counts[c] > 1)}
                bins += best_fit([(n[k], 1 << bit.setdefault(source[k], len(bit)), repeated.get(cluster[k], 0))
                                  for k in range(s, e)], capacity)
                s = e
            yield pa.RecordBatch.from_arrays(
                [t.column(c).combine_chunks() for c in ("shard", "doc_id", "source", "start", "n")] + [pa.array(bins, pa.int64())],
                names=["shard", "doc_id", "source", "start", "n", "bin"])
    ordered = dealt.repartition(parts, "shard").sortWithinPartitions(
        "shard", F.desc("n"), "doc_id", "start", "source", "cluster")
    packed = ordered.mapInArrow(run, PACKED)
    loads = F.sum("n").over(Window.partitionBy("shard", "bin"))
    return packed.select("doc_id", "source", "start", F.col("n").alias("n_tokens"),
                         F.concat_ws("-", F.col("shard").cast("string"), F.col("bin").cast("string")).alias("bin_id"),
                         loads.alias("bin_tokens")).union(full.select(
        "doc_id", "source", "start", F.col("n").alias("n_tokens"),
        F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                    F.col("cluster").cast("string"), F.col("start").cast("string")).alias("bin_id"),
        F.col("n").alias("bin_tokens")))

