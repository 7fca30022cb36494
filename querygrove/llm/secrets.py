"""Secrets: patterns of keys, and a battery of randomness tests over every token.

A token is a run of at least ``LEAST`` characters of ``A-Za-z0-9+/_=-``.  Its
encoding is the smallest of ENCODINGS that holds its characters.  Three tests
ask whether the token is as random as that encoding allows, each against what
ordinary text does there, so that a short token can't pass for lack of evidence:

* chi-squared of the symbols' counts against a concentration of text;
* runs of character classes against half the changes of a random token;
* lag-one correlation of the symbols' numbers against a correlation of 0.5.

The three scores make one p-value (Stouffer).  Discoveries are controlled at
``RATE`` within each encoding and band of lengths (Benjamini-Hochberg over the
different tokens of the whole table), so the many short tokens don't hide the
long ones, and copies of a token count once.

Texts are read whole; null and empty ones have no spans.  Repeated rows get
equal answers, rows that share an id stay apart, and an empty table gives no
rows.  Spans of a kind go by their start; equal starts by kind as listed.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrove.session import write_and_read

# The patterns that every span of the three base kinds matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {"random_hex": DIGITS + LOWER[:6], "random_hex_upper": DIGITS + UPPER[:6], "random_base32": UPPER + "234567",
             "random_base36": DIGITS + LOWER, "random_base62": DIGITS + UPPER + LOWER,
             "random_base64": UPPER + LOWER + DIGITS + "+/", "random_base64url": UPPER + LOWER + DIGITS + "-_"}
KINDS = ["assign", "access", "hex", *ENCODINGS]

LEAST, RATE = 20, 0.01
CONCENTRATION = 0.055       # sum of squared symbol frequencies that text has at least
HEX_EFFECT = 0.5            # squared effect of digits with few letters
CORRELATION = 0.5
BINS, BIN_WIDTH = 400, 0.1  # of -log10 p
FOUND = ("array<struct<kind: int, start: long, end: long, band: int, bin: int, token: long>>")


def _class_table() -> tuple[np.ndarray, np.ndarray]:
    token, hexes = np.zeros(256, bool), np.zeros(256, bool)
    token[[ord(c) for c in DIGITS + LOWER + UPPER + "+/_=-"]] = True
    hexes[[ord(c) for c in DIGITS + LOWER[:6]]] = True
    return token, hexes


TOKEN, HEXES = _class_table()


def runs(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of true of at least ``least`` places."""
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False]))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def _tail(z: float) -> float:
    """Share of a normal variable above ``z``."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniformity(values: np.ndarray, size: int) -> float:
    """Score of the chi-squared statistic: how far below that of text of the same length."""
    n = len(values)
    counts = np.bincount(values, minlength=size)
    statistic = float((counts.astype(float) ** 2).sum()) * size / n - n
    effect = HEX_EFFECT if size <= 16 else size * CONCENTRATION - 1
    mean, spread = size - 1 + (n - 1) * effect, math.sqrt(2 * (size - 1) + 4 * (n - 1) * effect)
    return (mean - statistic) / spread


def class_changes(classes: np.ndarray, shares: np.ndarray) -> float:
    """Score of the number of runs of equal class: how far above half of a random token's changes."""
    n = len(classes) - 1
    rate = (1 - float((shares ** 2).sum())) / 2
    changes = int((classes[1:] != classes[:-1]).sum())
    return (changes - n * rate - 0.5) / math.sqrt(n * rate * (1 - rate))


def serial(values: np.ndarray) -> float:
    """Score of the lag-one correlation: how far inside plus and minus CORRELATION."""
    a, b = values[:-1] - values[:-1].mean(), values[1:] - values[1:].mean()
    spread = math.sqrt(float((a * a).sum()) * float((b * b).sum()))
    r = min(0.999, abs(float((a * b).sum()) / spread)) if spread else 0.999
    return (math.atanh(CORRELATION) - math.atanh(r)) * math.sqrt(len(values) - 4)


@lru_cache(maxsize=None)
def _tables(kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = ENCODINGS[kind]
    value, of = np.full(256, -1, np.int64), np.zeros(256, np.int64)
    for k, c in enumerate(letters):
        value[ord(c)] = k
        of[ord(c)] = 0 if c in DIGITS else 1 if c in LOWER else 2 if c in UPPER else 3
    shares = np.bincount(of[[ord(c) for c in letters]], minlength=4) / len(letters)
    return value, of, shares


def encoding(token: bytes) -> str | None:
    """The smallest encoding that holds the token's characters; padding at its end does not count."""
    seen = set(token.decode("ascii"))
    return next((k for k, letters in ENCODINGS.items() if seen <= set(letters)), None)


def evidence(token: bytes) -> tuple[str, int, float] | None:
    """Kind, band of lengths and -log10 p of a token; none for tokens of no encoding."""
    bare = token.rstrip(b"=")
    kind = encoding(bare)
    if kind is None or len(bare) < LEAST:
        return None
    value, of, shares = _tables(kind)
    raw = np.frombuffer(bare, np.uint8)
    values, classes = value[raw], of[raw]
    z = (uniformity(values, len(ENCODINGS[kind])) + class_changes(classes, shares) + serial(values)) / math.sqrt(3)
    p = _tail(z)
    return kind, int(2 * math.log2(len(bare))), -math.log10(p) if p > 0 else BINS * BIN_WIDTH


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds but hex, in code points; leftmost and apart per kind."""
    out = []
    low = raw.lower()
    if any(w in low for w in WORDS):
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        out += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out


def spans(text: str | None) -> list[dict]:
    """Base spans, and every token that can be tested with its band and bin, of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    found = [{"kind": k, "start": s, "end": e, "band": -1, "bin": -1, "token": 0} for k, s, e in base_spans(text, raw)]
    array = np.frombuffer(raw, np.uint8)
    tokens = [(s, e, *t) for s, e in runs(TOKEN[array], LEAST) if (t := evidence(raw[s:e]))]
    hexes = runs(HEXES[array], HEX_LEAST)
    if not tokens and not hexes:
        return found
    points = None if len(raw) == len(text) else np.cumsum((array & 0xC0) != 0x80)

    def at(byte: int) -> int:
        return byte if points is None else int(points[byte - 1]) if byte else 0
    found += [{"kind": 2, "start": at(s), "end": at(e), "band": -1, "bin": -1, "token": 0} for s, e in hexes]
    found += [{"kind": KINDS.index(kind), "start": at(s), "end": at(e), "band": band,
               "bin": max(0, min(BINS, int(log / BIN_WIDTH))), "token": xxhash.xxh64_intdigest(raw[s:e]) - 2 ** 63}
              for s, e, kind, band, log in tokens]
    return found


def limits(counts: list[tuple[int, int, int, int]], rate: float = RATE) -> dict[tuple[int, int], int]:
    """The least bin that is a discovery in each (kind, band), from (kind, band, bin, tokens)."""
    groups: dict[tuple[int, int], dict[int, int]] = {}
    for kind, band, b, n in counts:
        groups.setdefault((kind, band), {})[b] = n
    out = {}
    for key, bins in groups.items():
        total, above, least = sum(bins.values()), 0, BINS + 1
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if 10 ** (-b * BIN_WIDTH) * total <= rate * above:  # a bin's largest p-value
                least = b
        out[key] = least
    return out


def scan(docs: DataFrame, rate: float = RATE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, spans``: an array of kind (its name), start, end of every document."""
    def run(batches):
        kinds = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("band", pa.int32()),
                                    ("bin", pa.int32()), ("token", pa.int64())]))
        for batch in batches:
            found = [spans(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kinds)], names=["doc_id", "found"])
    kind_of_id = docs.schema[doc_id].dataType.simpleString()
    stored = write_and_read(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(
        run, f"doc_id {kind_of_id}, found {FOUND}"), "secrets")
    tested = stored.select(F.explode("found").alias("f")).filter("f.band >= 0").select("f.kind", "f.band", "f.bin", "f.token")
    # At most one row for each kind, band and bin: a few thousand, whatever the input.
    counts = tested.distinct().groupBy("kind", "band", "bin").agg(F.count("*").alias("n")).collect()
    least = limits([tuple(r) for r in counts], rate)
    pairs = [x for (k, b), v in least.items() for x in (F.lit(k * 1000 + b), F.lit(v))]
    by_band = F.create_map(*pairs) if pairs else F.create_map().cast("map<int,int>")
    names = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter("found", lambda f: (f["band"] < 0) | (f["bin"] >= F.try_element_at(by_band, f["kind"] * 1000 + f["band"])))
    ordered = F.array_sort(F.transform(kept, lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("k"), f["end"].alias("end"))))
    return stored.select("doc_id", F.transform(ordered, lambda f: F.struct(
        F.get(names, f["k"]).alias("kind"), f["start"].alias("start"), f["end"].alias("end"))).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    def written(items):
        return F.array_join(F.transform(items, lambda f: F.concat_ws(
            ":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("spans", lambda f: f["kind"].isin(*kinds))
    return scan(docs).select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                             F.sha2(written(of(*KINDS[:3])).cast("binary"), 256).alias("base_sha256"),
                             written(F.col("spans")).alias("spans"))
