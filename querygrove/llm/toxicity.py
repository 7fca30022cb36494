"""Toxicity by subword-bag embeddings averaged into a linear softmax.

Character n-grams of every word hash to rows of one embedding table, so an
unseen misspelling shares most of its vectors with the word it bends.  The
vectors of a segment are averaged and a linear softmax gives its class; table
and softmax are trained jointly in numpy on a bounded sample of labelled rows
(``max_rows`` of each label; of a text beyond ``SPANS`` times ``SPAN_CHARS``
characters a span at a seeded place in each of ``SPANS`` equal parts).  Digits
stand inside words, as misspellings put them there.  A text scores as its most toxic segment of
``segment`` bytes, so that a long text does not hide a short insult.  A label
belongs to a whole text, so training starts with whole texts and goes on with
the segment that scores highest in each.

As the softmax is linear, the model is applied as one number for each table
row.  Empty and null texts score as the prior of the sample; repeated rows and
ties get equal scores, and texts of any length are read whole.  With no label
of one kind the score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import below_share, held_out

ROWS, DIM, GRAMS, SEGMENT = 1 << 16, 8, (3, 4, 5), 100
MAX_ROWS, SPANS, SPAN_CHARS, EPOCHS, MIN_TEXTS = 3_000, 6, 1_000, 8, 4
THRESHOLD = 0.3
LR = 0.1
#: A-Z to a-z; every other ASCII byte that is neither letter nor digit parts words.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 else 32 if c < 97 or 122 < c < 128 else c
                 for c in range(256)], np.uint8)


def buckets(raw: np.ndarray):
    """For each n, the table rows of all n-grams inside a word (with its edges), and their places."""
    data = FOLD[raw].astype(np.uint32)
    for n in GRAMS:
        if len(data) < n:
            continue
        m = len(data) - n + 1
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        inside = np.ones(m, bool)
        for k in range(n):
            h = (h ^ data[k:k + m]) * np.uint32(0x01000193)
            if 0 < k < n - 1:
                inside &= data[k:k + m] != 32
        h ^= h >> np.uint32(15)
        at = np.flatnonzero(inside)
        yield (h[at] * np.uint32(0x85EBCA6B)) >> np.uint32(16), at


def _bag(raw: bytes):
    found = list(buckets(np.frombuffer(b" " + raw + b" ", np.uint8)))
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate([b for b, _ in found]), np.concatenate([a for _, a in found])


def train(texts: list[str], labels: list[int], seed: int = 5, min_texts: int = MIN_TEXTS) -> tuple[np.ndarray, float]:
    """One weight for each table row and a bias: embeddings times the softmax's difference."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (ROWS, DIM)).astype(np.float64)
    out = rng.normal(0, 0.1, (DIM, 2))
    bias = np.zeros(2)
    y = np.array(labels)
    bags = [_bag(t.encode()) for t in texts]
    # N-grams of few texts would only be learned by heart.
    seen = np.bincount(np.concatenate([np.unique(b) for b, _ in bags]), minlength=ROWS)
    often = seen >= min_texts
    table[~often] = 0.0
    bags = [(b[often[b]], a[often[b]]) for b, a in bags]
    segments = [a // SEGMENT for _, a in bags]
    order = np.arange(len(texts))
    g_table, g_out, g_bias = np.full(ROWS, 1e-6), np.full(out.shape, 1e-6), np.full(2, 1e-6)
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        weight = table @ (out[:, 1] - out[:, 0])
        for k in range(0, len(order), 16):
            some = order[k:k + 16]
            picked = []
            for t in some:
                b = bags[t][0]
                if epoch and len(b):
                    s = segments[t]
                    mean = np.bincount(s, weights=weight[b]) / np.maximum(1, np.bincount(s))
                    b = b[s == mean.argmax()]
                picked.append(b)
            sizes = np.array([max(1, len(b)) for b in picked])
            which = np.repeat(np.arange(len(some)), [len(b) for b in picked])
            flat = np.concatenate(picked) if picked else np.zeros(0, np.uint32)
            x = np.zeros((len(some), DIM))
            np.add.at(x, which, table[flat])
            x /= sizes[:, None]
            z = x @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            dx = p @ out.T
            d_out, d_bias = x.T @ p / len(some), p.mean(0)
            g_out += d_out ** 2
            g_bias += d_bias ** 2
            rows, inverse = np.unique(flat, return_inverse=True)
            d_rows = np.zeros((len(rows), DIM))
            np.add.at(d_rows, inverse, dx[which] / sizes[which][:, None])
            g_table[rows] += (d_rows ** 2).mean(1)
            table[rows] -= LR * d_rows / np.sqrt(g_table[rows])[:, None]
            out -= 0.1 * d_out / np.sqrt(g_out)
            bias -= 0.1 * d_bias / np.sqrt(g_bias)
    return table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def margins(texts: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """The largest margin among the segments of each text."""
    raws = [t.encode() for t in texts]
    # Each text starts a new segment of one buffer.
    room = np.array([-(-(len(r) + 2) // SEGMENT) * SEGMENT for r in raws])
    start = np.cumsum(room) - room
    data = np.full(int(room.sum()), 32, np.uint8)
    for r, s in zip(raws, start):
        data[s + 1:s + 1 + len(r)] = np.frombuffer(r, np.uint8)
    n = len(data) // SEGMENT
    total, count = np.zeros(n), np.zeros(n)
    for rows, at in buckets(data):
        s = at // SEGMENT
        total += np.bincount(s, weights=weight[rows], minlength=n)[:n]
        count += np.bincount(s, minlength=n)[:n]
    mean = np.where(count > 0, total / np.maximum(count, 1), 0.0)
    return np.maximum.reduceat(mean, start // SEGMENT) + bias if len(raws) else np.zeros(0)


def sampled(text: Column) -> Column:
    """The whole of a text of at most ``SPANS * SPAN_CHARS`` characters (null: empty), of others a seeded span of each part."""
    length = F.length(text)
    part = F.floor(length / SPANS)
    spans = [F.substring(text, (part * k + F.pmod(F.xxhash64(text, F.lit(k)), part - SPAN_CHARS + 1) + 1).cast("int"),
                         F.lit(SPAN_CHARS)) for k in range(SPANS)]
    return F.when(length <= SPANS * SPAN_CHARS, text).otherwise(F.concat_ws("\n", *spans))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """The model of a bounded sample: ``max_rows`` texts of each label, ``SPANS * SPAN_CHARS`` characters of each."""
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).filter(~held_out("doc_id"))
    chosen = below_share(known, "toxic", F.xxhash64("doc_id"), max_rows).withColumn(
        "r", F.row_number().over(order)).filter(F.col("r") <= max_rows).select("doc_id", "toxic")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "toxic", sampled(F.col("text")).alias("text")).groupBy("doc_id", "toxic").agg(
        F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.toxic))
    y = [int(r.toxic) for r in rows]
    if len(set(y)) < 2:
        return {"weight": np.zeros(ROWS, np.float32), "bias": 0.0, "shift": -np.inf}
    # A fifth of the sample is kept from training; the threshold that parts its labels best becomes score 0.3.
    own = [k for k in range(len(rows)) if k % 5 or len(rows) < 100]
    weight, bias = train([rows[k].text for k in own], [y[k] for k in own])
    rest = [k for k in range(len(rows)) if k % 5 == 0 or len(rows) < 100]
    y = [y[k] for k in rest]
    z = margins([rows[k].text for k in rest], weight, bias)
    order_ = np.argsort(-z)
    hit = np.cumsum(np.array(y)[order_])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + sum(y))
    best = int(f1.argmax())
    cut = (z[order_[best]] + z[order_[min(best + 1, len(y) - 1)]]) / 2
    return {"weight": weight, "bias": bias, "shift": float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)}


def score(docs: DataFrame, model: dict, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row, over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            z, k = [], 0
            while k < len(texts):
                size, e = 0, k
                while e < len(texts) and (e == k or size + len(texts[e]) < 4_000_000):
                    size += len(texts[e])
                    e += 1
                z.append(margins(texts[k:e], m["weight"], m["bias"]))
                k = e
            z = np.concatenate(z) + m["shift"] if z else np.zeros(0)
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), learned from the rows that are not held out."""
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
