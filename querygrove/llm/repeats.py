"""Suffix-array dedup by depth-limited radix passes over windows of bytes.

A byte goes if a ``width``-byte string over it also starts earlier: in a row of
smaller id, or further ahead in the same text.  Suffixes are ordered only to
``width`` bytes, most significant digit first, and a group that has one member
is dropped after each pass:

1. The first digit is the synchronising gram of a window: of its ``GRAM``-byte
   strings the one with the least hash.  Equal windows hold it at the same
   place, and neighbouring windows share it, so one row stands for a run of
   windows.  Grams that occur once end here.
2. The second digit is the hash of all bytes that a run covers.  Equal runs are
   repeats whole, but for the first of them.
3. Runs that share only the gram are told apart by the bytes at their sides;
   windows that are equal to the full width are the repeats.

A task resolves the repeats within its own buffer before anything is shuffled:
those rows are dealt out evenly, and only the first of a buffer's copies goes to
its group.  Grams that a sample of pieces finds in about ``hot_rows`` runs or more are
dealt by the second digit at once and then by single windows, so that no task
gets all that surrounds a common gram; so are, after the second digit, other
grams with more than ``hot`` different surroundings.  Both ways give the same
repeats; the sample only chooses between them.  Equality of surroundings is
judged by 128 hash bits.

Null and empty texts have no bytes and lose none.  A null id comes before all
others.  Rows that share an id, null or not, are documents of their own, in the
order of a digest of their text.  Texts are read whole, however long.  Repeated
rows lose all but the first.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querygrove.session import write_and_read

from .common import groups_of

WIDTH, GRAM, HOT = 100, 32, 50_000
#: Of pieces of so many bytes one in ``ONE_IN`` is read for common grams; at most ``MAX_COMMON`` of them are sent to the tasks.
PIECE, ONE_IN, HOT_ROWS, MAX_COMMON = 2_048, 32, 20_000, 100_000
BLOCK = 1 << 19
FIRST_ID = -(1 << 63)
_U = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLES = [np.random.default_rng(s).integers(0, 2 ** 63, 256, np.uint64) * _U(2) + _U(1) for s in (7, 11)]


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, _U)
    p[0] = 1
    return np.cumprod(p, dtype=_U)


_SPAN = BLOCK + 4 * WIDTH
_POW = [_powers(b, _SPAN) for b in _ODD]
_INV = [_powers(pow(b, -1, 2 ** 64), _SPAN) for b in _ODD]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class Hashes:
    """Hashes of any span of a buffer, from sums over its bytes."""

    def __init__(self, data: np.ndarray):
        self.sums = [np.concatenate([np.zeros(1, _U), np.cumsum(t[data] * p[:len(data)], dtype=_U)])
                     for t, p in zip(_TABLES, _POW)]

    def of(self, k: int, start, end) -> np.ndarray:
        return _mix((self.sums[k][end] - self.sums[k][start]) * _INV[k][start])


def runs(data: np.ndarray, doc: np.ndarray, width: int):
    """Runs of windows of one buffer: (gram place, first start, last start), and the hashes."""
    hashes = Hashes(data)
    n = len(data) - GRAM + 1
    at = np.arange(n)
    bits = _U((1 << 20) - 1)
    least = (hashes.of(0, at, at + GRAM) & ~bits) | at.astype(_U)
    grams = width - GRAM + 1
    whole, span = least, 1
    while span * 2 <= grams:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n_windows = len(whole) - grams + 1
    least = np.minimum(least[:n_windows], least[grams - span:grams - span + n_windows])
    place = (least & bits).astype(np.int64)
    start = np.flatnonzero(doc[:n_windows] == doc[width - 1:width - 1 + n_windows])
    if not len(start):
        return None, None, None, hashes
    place = place[start]
    new = np.r_[True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    return place[first], start[first], start[last], hashes


def buffers(batches, width: int):
    """(bytes, row number of each byte, places in the text, ids) of at most BLOCK bytes.

    Long texts go in parts that overlap by width - 1 bytes, so that each window is in one part.
    """
    parts, size = [], 0

    def built():
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        lens = np.array([len(p[2]) for p in parts])
        row = np.repeat(np.arange(len(parts)), lens)
        return data, row, np.array([p[1] for p in parts], np.int64), np.array([p[0] for p in parts], np.int64), \
            np.cumsum(lens) - lens
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for i, value in zip(ids, batch.column(1)):
            raw = (value.as_py() or "").encode()
            for a in range(0, max(1, len(raw) - width + 1), BLOCK // 2):
                piece = raw[a:a + BLOCK // 2 + width - 1]
                if len(piece) < width:
                    continue
                if size + len(piece) > BLOCK:
                    yield built()
                    parts, size = [], 0
                parts.append((FIRST_ID if i is None else i, a, piece))
                size += len(piece)
    if parts:
        yield built()


def _frame(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _first(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray):
    """Order by keys and then place; the order, group starts and a mask of rows that repeat a group's first."""
    order = np.lexsort([at, doc, *keys[::-1]])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    group = np.cumsum(new) - 1
    lead = order[np.flatnonzero(new)][group] if len(order) else order
    later = (doc[order] != doc[lead]) | (at[order] != at[lead])
    return order, new, later


RUN = "gram long, hash long, doc long, at long, lead short, n short"
FOUND = "doc long, at long, n int, lead short, open short, gram long"


def _sample_grams(width: int):
    """(gram, number of runs) of one in ``ONE_IN`` pieces of all texts, counted for each buffer."""
    def pieces(batches):
        for batch in batches:
            out = []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (value.as_py() or "").encode()
                number = np.arange(-(-len(raw) // PIECE)).astype(_U)
                draw = _mix(_mix(number + _U(1)) ^ _U((i or 0) & (2 ** 64 - 1)))
                out += [raw[k * PIECE:(k + 1) * PIECE] for k in np.flatnonzero(draw % _U(ONE_IN) == 0).tolist()]
            yield out

    def run(batches):
        for found in pieces(batches):
            for k in range(0, len(found), BLOCK // PIECE):
                some = [raw for raw in found[k:k + BLOCK // PIECE] if len(raw) >= width]
                if not some:
                    continue
                row = np.repeat(np.arange(len(some)), [len(raw) for raw in some])
                place, _, _, hashes = runs(np.frombuffer(b"".join(some), np.uint8), row, width)
                gram, count = np.unique(hashes.of(0, place, place + GRAM), return_counts=True)
                yield _frame(gram=gram.view(np.int64), c=count)
    return run


def common_grams(rows: DataFrame, width: int, hot_rows: int) -> np.ndarray:
    """The grams of about ``hot_rows`` runs or more, the most frequent ``MAX_COMMON`` of them, in order."""
    counts = rows.mapInArrow(_sample_grams(width), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    found = counts.filter(F.col("c") * ONE_IN >= hot_rows).orderBy(F.desc("c"), "gram").limit(MAX_COMMON).collect()
    return np.sort(np.array([r.gram for r in found], np.int64).view(_U))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _send_runs(width: int, common):
    """Runs by the key that deals them: the gram, for common grams both digits, for repeats of a buffer any."""
    def run(batches):
        for data, row, base, ids, offset in buffers(batches, width):
            place, first, last, hashes = runs(data, row, width)
            if place is None:
                continue
            lead, n = (place - first), (last - first + 1)
            gram = hashes.of(0, place, place + GRAM)
            side = hashes.of(1, first, last + width) ^ _mix((lead * 1000 + n).astype(_U))
            r = row[first]
            doc, at = ids[r], first - offset[r] + base[r]
            order, _, later = _first([gram, side], doc, at)
            gram, side, doc, at, lead, n = (x[order] for x in (gram, side, doc, at, lead, n))
            hot = _among(gram, common.value)
            key = np.where(hot, _mix(gram ^ side), gram)
            key = np.where(later, _mix(_mix(doc.astype(_U)) ^ at.astype(_U)), key)
            # Repeats of this buffer are sure already: n below zero marks them; lead below zero marks common grams.
            yield _frame(gram=key.view(np.int64), hash=side.view(np.int64), doc=doc, at=at,
                         lead=np.where(hot, -1, lead).astype(np.int16), n=np.where(later, -n, n).astype(np.int16))
    return run


def _second_digit(hot: int):
    def run(batches):
        for t in groups_of(batches, ["gram"]):
            gram, side, doc, at, lead, n = (t.column(c).to_numpy() for c in ("gram", "hash", "doc", "at", "lead", "n"))
            new = np.r_[True, (gram[1:] != gram[:-1]) | (side[1:] != side[:-1])]
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)[group]
            later = (n < 0) | (doc != doc[first]) | (at != at[first])
            new_gram = np.r_[True, gram[1:] != gram[:-1]]
            g = np.cumsum(new_gram) - 1
            kinds = np.bincount(g, weights=new)[g]
            common = lead < 0
            keep = later | (new & ((kinds > 1) | common))
            is_open = np.where((kinds > hot) | common, 2, 1) * ~later
            yield _frame(doc=doc[keep], at=at[keep], n=np.abs(n[keep]).astype(np.int32), lead=lead[keep],
                         open=is_open[keep].astype(np.int16), gram=gram[keep])
    return run


SIDES = "gram long, doc long, at long, lead short, n short, bytes binary"


def _send_sides(width: int):
    """The bytes around the runs still open; runs of hot grams go window by window, repeats of a batch marked."""
    def run(batches):
        for batch in batches:
            out = []
            seen: dict = {}
            for i, text, found in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                raw = (text or "").encode()
                for f in found:
                    at, n, lead = f["at"], f["n"], f["lead"]
                    if f["open"] == 1:
                        out.append((f["gram"], i, at, lead, n, raw[at:at + n - 1 + width]))
                        continue
                    for s in range(at, at + n):
                        w = raw[s:s + width]
                        now, was = (i, s), seen.get(w)
                        if was is None or now < was:
                            seen[w] = now
                        if was is not None and was != now:
                            i2, s2 = max(now, was)
                            out.append((hash((i2, s2)), i2, s2, 0, -1, b""))
            for w, (i, s) in seen.items():
                key = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True)
                out.append((key, i, s, 0, 1, w))
            for k in range(0, len(out), 20_000):
                g, i, a, lead, n, b = zip(*out[k:k + 20_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g, pa.int64()), pa.array(i, pa.int64()), pa.array(a, pa.int64()),
                     pa.array(lead, pa.int16()), pa.array(n, pa.int16()), pa.array(b, pa.binary())],
                    names=["gram", "doc", "at", "lead", "n", "bytes"])
    return run


def _last_digits(width: int):
    """Windows of runs that share a gram, told apart to the full width; yields repeats."""
    def run(batches):
        for t in groups_of(batches, ["gram"]):
            gram, doc, at, lead, n = (t.column(c).to_numpy() for c in ("gram", "doc", "at", "lead", "n"))
            sure = n < 0
            out_doc, out_at = [doc[sure]], [at[sure]]
            rows = np.flatnonzero(~sure)
            raws = t.column("bytes").to_pylist()
            step = 4_000
            k = 0
            while k < len(rows):
                e = min(len(rows), k + step)
                while e < len(rows) and gram[rows[e]] == gram[rows[e - 1]]:
                    e += 1
                some = rows[k:e]
                k = e
                keys = [[], [], []]
                wd, wa = [], []
                for c in _chunks(some, n, width):
                    data = np.frombuffer(b"".join(raws[r] for r in c), np.uint8)
                    hashes = Hashes(data)
                    lens = n[c].astype(np.int64) + width - 1
                    offset = np.cumsum(lens) - lens
                    count = n[c].astype(np.int64)
                    which = np.repeat(np.arange(len(c)), count)
                    j = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                    s = offset[which] + j
                    keys[0].append(gram[c][which])
                    keys[1].append(hashes.of(0, s, s + width))
                    keys[2].append(hashes.of(1, s, s + width))
                    wd.append(doc[c][which])
                    wa.append(at[c][which] + j)
                wd, wa = np.concatenate(wd), np.concatenate(wa)
                order, _, later = _first([np.concatenate(x) for x in keys], wd, wa)
                out_doc.append(wd[order][later])
                out_at.append(wa[order][later])
            d, a = np.concatenate(out_doc), np.concatenate(out_at)
            order = np.lexsort([a, d])
            d, a = d[order], a[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (a[1:] > a[:-1] + 1)
            first = np.flatnonzero(new)
            if not len(first):
                continue
            last = np.r_[first[1:], len(d)] - 1
            yield _frame(doc=d[first], at=a[first], n=(a[last] - a[first] + 1).astype(np.int32))
    return run


def _chunks(rows: np.ndarray, n: np.ndarray, width: int):
    lens = np.cumsum(n[rows].astype(np.int64) + width - 1)
    return np.split(rows, np.flatnonzero(np.diff(lens // BLOCK)) + 1)


def _union(found: list[dict] | None, width: int) -> list[tuple[int, int]]:
    """Maximal byte spans under windows that start at ``at`` .. ``at + n - 1``."""
    out: list[list[int]] = []
    for a, n in sorted((f["at"], f["n"]) for f in found or ()):
        end = a + n - 1 + width
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([a, end])
    return [(a, e) for a, e in out]


def numbered(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame | None:
    """``docs`` with ``_i``, rising with the id and then a digest of the text; None where ids are there and differ.

    The ids alone decide; only where some are shared or null is a copy of the rows stored.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("i")).groupBy("i").agg(F.count("*").alias("n"))
    if not ids.filter("n > 1 OR i IS NULL").head(1):
        return None
    order = ["_id", "_d", "_e"]
    rows = docs.select("*", F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_d"), F.xxhash64(F.lit(7), text).alias("_e"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return write_and_read(sorted_.withColumn("_i", F.monotonically_increasing_id()).drop(*order), "numbered")


def removals(docs: DataFrame, width: int = WIDTH, hot: int = HOT, text: str = "text", doc_id: str = "doc_id",
             as_text: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``row`` (all columns) with n_bytes, spans (array of start, end) and kept of every document.

    ``kept`` is the bytes left, or with ``as_text`` their text without the characters that a cut broke.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = docs.columns
    if (own := numbered(docs, text, doc_id)) is not None:
        docs, doc_id = own, "_i"
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    common = spark.sparkContext.broadcast(common_grams(rows, width, hot_rows))
    sent = rows.mapInArrow(_send_runs(width, common), RUN)
    by_gram = sent.repartition(parts, "gram").sortWithinPartitions("gram", "hash", "doc", "at")
    found = write_and_read(by_gram.mapInArrow(_second_digit(hot), FOUND), "runs")

    # Both joins below read the same exchange of texts.
    texts = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST_ID)).alias("i"), F.struct(*columns).alias("row")
                        ).repartition(parts, "i")
    open_runs = found.filter("open > 0").groupBy("doc").agg(
        F.collect_list(F.struct("at", "n", "lead", "open", "gram")).alias("found")).withColumnRenamed("doc", "i")
    sides = texts.join(open_runs, "i").select("i", F.col("row")[text].alias("t"), "found").mapInArrow(
        _send_sides(width), SIDES)
    repeats = sides.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(
        _last_digits(width), "doc long, at long, n int")
    spans = found.filter("open = 0").select("doc", "at", "n").union(repeats).groupBy("doc").agg(
        F.collect_list(F.struct("at", "n")).alias("found")).withColumnRenamed("doc", "i")
    joined = texts.join(spans, "i", "left").select("row", F.col("row")[text].alias("t"), "found")

    def cut(batches):
        for batch in batches:
            n_bytes, all_spans, kept = [], [], []
            for text_, found_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text_ or "").encode()
                spans_ = [(a, min(e, len(raw))) for a, e in _union(found_, width) if a < len(raw)]
                edges = [0, *[x for s in spans_ for x in s], len(raw)]
                n_bytes.append(len(raw))
                all_spans.append([{"start": a, "end": e} for a, e in spans_])
                left = b"".join(raw[a:e] for a, e in zip(edges[::2], edges[1::2]))
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(all_spans, kinds),
                 pa.array(kept, pa.string() if as_text else pa.binary())],
                names=["row", "n_bytes", "spans", "kept"])
    out = T.StructType([joined.schema["row"], T.StructField("n_bytes", T.LongType()),
                        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                                         T.StructField("end", T.LongType())]))),
                        T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    return joined.mapInArrow(cut, out)


def digest(docs: DataFrame, width: int = WIDTH, hot: int = HOT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    found = removals(docs.select("doc_id", "text"), width, hot, hot_rows=hot_rows)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the text that is left; a cut inside a character drops that character, n_chars follows."""
    found = removals(docs, width, as_text=True).withColumn("whole", F.size("spans") == 0)
    own = {"text": F.when(F.col("whole"), F.col("row.text")).otherwise(F.col("kept")).alias("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("whole"), F.col("row.n_chars")).otherwise(
            F.length("kept").cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    return found.select(*[own.get(c, F.col("row")[c].alias(c)) for c in docs.columns])
