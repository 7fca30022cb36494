"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases of code points: each is the longest
phrase already known and one more code point.  The set of phrases stands for
the text.  Every phrase is hashed once; the leading bits of the hash choose one
of ``SIZE`` slots and the least hash of each slot is kept (16 bits of it), which
is the fingerprint.  Two fingerprints are as alike as the share of slots that
agree among those that either fills, which estimates the likeness of the phrase
sets with a deviation of 0.05 at most.

Null and empty texts have the fingerprint of no phrases, which is like itself
and nothing else.  Equal texts have equal fingerprints.  A text is parsed whole
in the task that holds it; its phrases, fewer than its code points, are held
until it is done.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SIZE = 128
_EMPTY = 0xFFFF
_BASE = 0x9E3779B97F4A7C15


def parse(text: str, known: set[str], phrase: str = "") -> tuple[list[str], str]:
    """The new phrases of ``text``, which join ``known``, and the phrase open at its end; ``phrase`` was open before."""
    add, fresh = known.add, []
    found = fresh.append
    for c in text:
        phrase += c
        if phrase not in known:
            add(phrase)
            found(phrase)
            phrase = ""
    return fresh, phrase


def hashes(phrases: list[str]) -> np.ndarray:
    """64 bits for each phrase: its code points as digits to an odd base, mixed."""
    if not phrases:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, phrases), np.int64, len(phrases))
    codes = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum(size) - size
    power = np.full(int(size.max()), _BASE, np.uint64)
    power[0] = 1
    place = np.arange(len(codes)) - np.repeat(start, size)
    x = np.add.reduceat((codes + np.uint64(1)) * np.multiply.accumulate(power)[place], start)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(found: np.ndarray) -> np.ndarray:
    """SIZE slots of 16 bits: the least hash of those whose leading bits name the slot."""
    out = np.full(SIZE, _EMPTY, np.uint16)
    found = np.sort(found)
    slot = (found >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else slot
    out[slot[first]] = np.minimum((found[first] >> np.uint64(41)) & np.uint64(0xFFFF), _EMPTY - 1)
    return out


class Parsed:
    """A text parsed in two steps, so that its edited text need not parse again what both begin with."""

    def __init__(self, text: str):
        self.text, self.half = text, len(text) // 2
        common = len(text) - self.half
        self.known: set[str] = set()
        fresh, self.phrase = parse(text[:common], self.known)
        self.begun = hashes(fresh)
        self.fingerprint = self.ended(text[common:])

    def ended(self, rest: str) -> np.ndarray:
        """The fingerprint of the text's beginning followed by ``rest``."""
        fresh, _ = parse(rest, self.known.copy(), self.phrase)  # a phrase open at the end is a known one
        return slots(np.concatenate([self.begun, hashes(fresh)]))

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The text whose last half is the start of ``following``, and its fingerprint."""
        rest = following[:self.half]
        whole = self.text[:len(self.text) - self.half] + rest
        return whole, self.fingerprint if whole == self.text else self.ended(rest)


def phrase_hashes(text: str | None) -> np.ndarray:
    """Hashes of the phrases of a text."""
    return hashes(parse(text or "", set())[0])


def signature(text: str | None) -> np.ndarray:
    """The fingerprint of a text."""
    return slots(phrase_hashes(text))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != _EMPTY) | (b != _EMPTY)
    return float((a == b)[filled].mean()) if filled.any() else 1.0


def _bounds(docs: DataFrame, buckets: int) -> list[int]:
    """Ids that part the rows into about equal ranges."""
    points = [k / buckets for k in range(1, buckets)]
    found = docs.agg(F.percentile_approx("doc_id", points, 10_000)).first()[0] if points else None
    return sorted(set(found or ()))


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
       " near_edited double, near_next double")


def compare_with_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every row with the fingerprint of its edited text, whose last half is the start of the next row's text.

    Rows are ordered by (doc_id, text), null ids last; the row after the last
    is the first; rows that tie in both are equal, so their order is free.  An
    empty table gives no rows.  Ranges of ids are streamed in order, each with
    the first row of the range after it, so no range waits for another.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last_id = (1 << 63) - 1
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(last_id)).alias("doc_id"),
                       F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = _bounds(rows.select("doc_id"), buckets or 4 * parts)
    # A bucket is the number of bounds at or below the id; equal ids share one.
    at = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<bigint>"), lambda b: b <= F.col("doc_id")))
    placed = rows.withColumn("bucket", at.cast("long"))
    firsts = sorted((r.bucket, r.first) for r in placed.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect())
    if not firsts:
        return spark.createDataFrame([], OUT)
    # The smallest rows of each bucket go to the bucket before it too, as its end.
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}
    # One row for each bucket: four times as many as there are shuffle partitions.
    lookup = F.broadcast(spark.createDataFrame(list(before.items()), "doc_id long, prior long"))
    prior = F.col("prior")
    sent = placed.join(lookup, "doc_id", "left").withColumn("to", F.explode(F.array_compact(F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("end")),
        F.when(prior.isNotNull(), F.struct(prior.cast("long").alias("bucket"), F.lit(1).alias("end"))))))).select(
        "to.bucket", "to.end", "doc_id", "no_id", "text")
    ordered = sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "end", "doc_id", "no_id", "text")

    def run(batches):
        held = None
        out: list[tuple] = []

        def pair(now, after):
            i, own = now
            edited, fp = own.edited(after.text)
            out.append((i, len(own.text), hashlib.sha256(edited.encode()).hexdigest(), own.fingerprint.tobytes().hex(),
                        fp.tobytes().hex(), likeness(own.fingerprint, fp), likeness(own.fingerprint, after.fingerprint)))
        closed = None
        for batch in batches:
            for bucket, end, i, no_id, text in zip(*[c.to_pylist() for c in batch.columns]):
                if end and closed == bucket:
                    continue
                read = Parsed(text)
                if held is not None:
                    pair(held, read)
                if end:
                    held, closed = None, bucket
                else:
                    held = (None if no_id else i, read)
            if out:
                yield _batch(out)
                out.clear()
    return ordered.mapInArrow(run, OUT)


def _batch(rows):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
