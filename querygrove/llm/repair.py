"""Repair of conversation structure at least cost, by grammar-compressed dynamic programming.

A row is one of sixteen symbols: the initial of its role (s, u, a, other) and
its first fault (none, blank, duplicate, truncated).  Symbols of a task's
conversations, in blocks of at most ``BLOCK``, are compressed together by
Re-Pair.  Each symbol and each rule has one min-plus matrix over the four
states of ``(s?(ua)+)?``: the least cost from state to state and the audit that
comes first among the cheapest, as a rope that shares the ropes of the rule's
parts.  A rule is evaluated once, after its parts, for all conversations; a
block is the product over its compressed symbols, a conversation over its
blocks.  Equal costs never leave one audit as the beginning of another, so
products keep the order of audits.

Edits: K keeps a row (0), R gives it the role that the place asks for (2), D
deletes it (3, and the only edit of a blank or duplicate one), I inserts an
empty text anywhere (2); a truncated row that stays costs 1 more.

``conversations`` has conv_id, turn, role and text, and may have more columns.
Nulls in role and text are one space.  Rows without a conv_id belong to no
conversation.  Null turns come first; rows of equal turn go by role, then by a
digest of role and text, so that equal rows are side by side.  Texts are
whole.  A conversation without rows has zeros, an empty audit and no rows.  An
empty table gives none.  The rows of one conversation pass through one task,
one after another, as the digest of its text asks for; all else is dealt by
ranges and blocks.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querygrove.session import write_and_read

from .ropes import EMPTY, Rope, join, less, rope, written
from .rows import digests, placed, spans

BLOCK, CHUNK, USES = 512, 100_000, 2
ROLES, FAULTS = "suao", ("", "blank", "duplicate", "truncated")
STATES, ACCEPTED = 4, (0, 3)  # nothing yet, after s, after u, after a
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 2), ("D", 3), ("I", 2)
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"

Matrix = list[list["tuple[int, Rope] | None"]]


def moves(role: str) -> list[tuple[int, int]]:
    """The steps between states that a row of this role makes."""
    return {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}.get(role, [])


def better(new: tuple[int, Rope], old: tuple[int, Rope] | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and less(new[1], old[1]))


def times(left: Matrix, right: Matrix) -> Matrix:
    """Min-plus product; rows of ``left`` may be fewer than the states."""
    out: Matrix = []
    for row in left:
        made: list = [None] * STATES
        for k, first in enumerate(row):
            if first is None:
                continue
            for j, second in enumerate(right[k]):
                if second is None or (made[j] is not None and first[0] + second[0] > made[j][0]):
                    continue
                both = (first[0] + second[0], join(first[1], second[1]))
                if better(both, made[j]):
                    made[j] = both
        out.append(made)
    return out


def _edits(steps: list[tuple[int, int, int, str]]) -> Matrix:
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for i, j, cost, letter in steps:
        if better(new := (cost, rope(letter)), out[i][j]):
            out[i][j] = new
    return out


def _inserts() -> Matrix:
    """Any number of insertions: as few as lead from state to state."""
    one = _edits([(i, i, 0, "") for i in range(STATES)] + [(i, j, INSERT[1], INSERT[0]) for r in "ua" for i, j in moves(r)])
    return times(one, one)  # two lead anywhere


def _symbol(code: int) -> Matrix:
    role, fault = ROLES[code // len(FAULTS)], FAULTS[code % len(FAULTS)]
    steps = [(i, i, DELETE[1], DELETE[0]) for i in range(STATES)]
    if fault not in ("blank", "duplicate"):
        more = int(fault == "truncated")
        steps += [(i, j, KEEP[1] + more, KEEP[0]) for i, j in moves(role)]
        steps += [(i, j, REROLE[1] + more, REROLE[0]) for r in "ua" for i, j in moves(r)]
    return times(INSERTS, _edits(steps))


INSERTS = _inserts()
SYMBOLS = [_symbol(code) for code in range(len(ROLES) * len(FAULTS))]
START: Matrix = [[(0, EMPTY), None, None, None]]
EVERY: Matrix = [[(0, EMPTY) if i == j else None for j in range(STATES)] for i in range(STATES)]


def re_pair(sequences: list[np.ndarray], uses: int = USES) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Rules (left, right), numbered after the symbols, and the sequences in them.

    The most frequent pair becomes a rule until none occurs ``uses`` times.
    """
    ends = np.cumsum([len(s) + 1 for s in sequences])
    whole = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int64)
    for s, e in zip(sequences, ends.tolist()):
        whole[e - 1 - len(s):e - 1] = s
    rules: list[tuple[int, int]] = []
    wide = 1 << 31
    while len(whole) > 1:
        a, b = whole[:-1], whole[1:]
        codes = np.where((a >= 0) & (b >= 0), a * wide + b, -1)
        pairs, counts = np.unique(codes, return_counts=True)
        counts = np.where(pairs // wide == pairs % wide, (counts + 1) // 2, counts)  # a run of equal symbols overlaps
        counts[pairs < 0] = 0
        best = int(counts.argmax())
        if counts[best] < uses:
            break
        left, right = divmod(int(pairs[best]), wide)
        at = np.flatnonzero(codes == pairs[best])
        if left == right:
            first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))) % 2 == 0]
        whole[at] = len(SYMBOLS) + len(rules)
        whole = np.delete(whole, at + 1)
        rules.append((left, right))
    cuts = np.flatnonzero(whole < 0)
    return rules, [whole[s + 1:e] for s, e in zip([-1, *cuts[:-1].tolist()], cuts.tolist())]


def solve(blocks: list[tuple[str, bool]]) -> dict[tuple[str, bool], Matrix]:
    """The matrix of each different block (symbols as letters, whether a conversation starts with it)."""
    texts = sorted({t for t, _ in blocks})
    rules, packed = re_pair([np.frombuffer(t.encode(), np.uint8).astype(np.int64) - ord("A") for t in texts])
    known = list(SYMBOLS)
    for left, right in rules:
        known.append(times(known[left], known[right]))
    of = dict(zip(texts, packed))
    out = {}
    for text, first in set(blocks):
        made = START if first else EVERY
        for symbol in of[text].tolist():
            made = times(made, known[symbol])
        out[text, first] = made
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, by a digest of conversation and turn: a row in twenty each is dropped, emptied,
    robbed of its marks, repeated, or given the role user."""
    def named(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), kind.alias("_k"))
    text = F.when(F.col("_k") == 1, F.lit("")).when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter("_k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_c")).drop("_c")


def _plain(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return rows.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        text.alias("text"), *digests(role, text))


def symbols(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, rank, code`` of every row of ``rows`` (as _plain gives them); stored."""
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin(*ROLES[:3]), F.instr(F.lit(ROLES), initial) - 1).otherwise(len(ROLES) - 1)
    narrow = rows.select("conv_id", "turn", "role", "d1", "d2", role.alias("r"), (bare == "").alias("blank"),
                         ~F.substring(bare, -1, 1).isin(".", "!", "?") & True).toDF(
        "conv_id", "turn", "role", "d1", "d2", "r", "blank", "cut")
    stored = placed(narrow)
    parts = spans(stored)
    # A pid holds the rest of at most one conversation of lower pids, so these are no more than pids.
    wide = F.broadcast(parts.filter("before > 0").select("conv_id").distinct().withColumn("wide", F.lit(True)))
    marked = stored.join(wide, "conv_id", "left")
    seen = Window.partitionBy("conv_id", "d1", "d2").orderBy("pid")  # one row for each pid at most
    firsts = marked.filter("wide AND NOT again").withColumn("again", F.row_number().over(seen) > 1)
    known = marked.filter("wide IS NULL OR again").unionByName(firsts).join(parts, ["conv_id", "pid"])
    fault = F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("cut"), 3).otherwise(0)
    return write_and_read(known.select("conv_id", "turn", (F.col("before") + F.col("place")).alias("rank"),
                                       (F.col("r") * len(FAULTS) + fault).alias("code")), "symbols")


def _solved(stored: DataFrame) -> DataFrame:
    """``conv_id, block, roles, illegal, matrix``: what a conversation needs of each of its blocks."""
    letter = F.char(F.col("code") + ord("A"))
    blocks = stored.groupBy("conv_id", F.floor((F.col("rank") - 1) / BLOCK).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", letter.alias("c")))), lambda x: x["c"]), "").alias("codes"))

    def run(batches):
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "codes"))))
            start = 0
            while start < len(rows):
                end, distinct, size = start, set(), 0
                while end < len(rows) and size < CHUNK:
                    if rows[end][2] not in distinct:
                        distinct.add(rows[end][2])
                        size += len(rows[end][2])
                    end += 1
                part, start = rows[start:end], end
                found = solve([(codes, block == 0) for _, block, codes in part])
                packed = {k: json.dumps([[e and [e[0], written(e[1])] for e in row] for row in m]) for k, m in found.items()}
                kinds = [[ROLES[(ord(c) - ord("A")) // len(FAULTS)] for c in codes] for _, _, codes in part]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()),
                    pa.array([k[0] + k[-1] for k in kinds]),
                    pa.array([sum(a + b not in LEGAL for a, b in zip(k, k[1:])) for k in kinds], pa.int64()),
                    pa.array([packed[r[2], r[1] == 0] for r in part])],
                    names=["conv_id", "block", "roles", "illegal", "matrix"])
    return blocks.mapInArrow(run, "conv_id long, block long, roles string, illegal long, matrix string")


class _Conversation:
    """The state of one conversation while its blocks and rows go by."""

    def __init__(self, conv_id: int, counts: tuple):
        self.conv_id, self.counts = conv_id, counts
        self.vector, self.illegal, self.last = START, 0, None
        self.audit, self.at, self.state, self.lines = None, 0, 0, 0
        self.cost, self.hash = 0, hashlib.sha256()

    def block(self, roles: str, illegal: int, matrix: str) -> None:
        self.illegal += illegal + (self.last is not None and self.last + roles[0] not in LEGAL)
        self.last = roles[1]
        whole = [[e and (e[0], rope(e[1])) for e in row] for row in json.loads(matrix)]
        self.vector = times(self.vector, whole if len(whole) == STATES else whole * STATES) if self.vector is not START else whole

    def settle(self) -> str:
        """The audit, once all blocks have been seen."""
        if self.audit is None:
            best = None
            for state in ACCEPTED:
                entry = times(self.vector, INSERTS)[0][state]
                if entry is not None and better(entry, best):
                    best = entry
            self.cost, self.audit = best[0], written(best[1])
        return self.audit

    def _put(self, role: str, text: str, letter: str):
        self.hash.update((b"\n" if self.lines else b"") + f"{role}:{text}".encode())
        self.lines += 1
        initial = role[:1]
        self.state = next(j for i, j in moves(initial) if i == self.state)
        return self.conv_id, self.lines, role, text, letter

    def _asked(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def inserted(self):
        """The rows inserted before the next row of the conversation."""
        while self.at < len(self.settle()) and self.audit[self.at] == INSERT[0]:
            self.at += 1
            yield self._put(self._asked(), "", INSERT[0])

    def row(self, role: str, text: str):
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != DELETE[0]:
            yield self._put(role if letter == KEEP[0] else self._asked(), text, letter)

    def result(self) -> tuple:
        gaps, blank, duplicate, truncated = self.counts
        return (self.conv_id, gaps, blank, duplicate, truncated, self.illegal, self.cost, self.audit, self.hash.hexdigest())


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
TURN = "conv_id long, place long, role string, text string, edit string"


def _replayed(conv_ids: DataFrame, rows: DataFrame, as_turns: bool) -> DataFrame:
    stored = symbols(rows)
    fault = F.col("code") % len(FAULTS)
    counts = stored.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *[F.count_if(fault == k).alias(FAULTS[k]) for k in (1, 2, 3)])
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    shape = ["conv_id", "kind", "ord", "turn", "role", "d1", "d2", "text", "x1", "x2", "x3", "x4"]
    info = conv_ids.join(counts, "conv_id", "left").select(
        "conv_id", F.lit(0), zero, zero, none, zero, zero, none,
        *[F.coalesce(c, zero) for c in ("gaps", *FAULTS[1:])]).toDF(*shape)
    blocks = _solved(stored).select("conv_id", F.lit(1), "block", zero, "roles", zero, zero, "matrix", "illegal",
                                    zero, zero, zero).toDF(*shape)
    texts = rows.select("conv_id", F.lit(2), zero, "turn", "role", "d1", "d2", "text", zero, zero, zero, zero).toDF(*shape)
    dealt = info.union(blocks).union(texts).repartition("conv_id").sortWithinPartitions(
        "conv_id", "kind", "ord", "turn", "role", "d1", "d2")

    def run(batches):
        now, out = None, []
        for batch in batches:
            for conv, kind, role, text, x1, x2, x3, x4 in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "kind", "role", "text", "x1", "x2", "x3", "x4"))):
                if kind == 0:
                    out += _closed(now, as_turns)
                    now = _Conversation(conv, (x1, x2, x3, x4))
                elif kind == 1:
                    now.block(role, x1, text)
                else:
                    lines = list(now.row(role, text))
                    if as_turns:
                        out += lines
            if out:
                yield _written(out, as_turns)
                out = []
        out += _closed(now, as_turns)
        if out:
            yield _written(out, as_turns)
    return dealt.mapInArrow(run, TURN if as_turns else RESULT)


def _closed(now: _Conversation | None, as_turns: bool) -> list[tuple]:
    if now is None:
        return []
    lines = list(now.inserted())
    return lines if as_turns else [now.result()]


def _written(out: list[tuple], as_turns: bool):
    names = [f.split()[0] for f in (TURN if as_turns else RESULT).split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place, role, text and the edit (K, R or I) that each is due to."""
    rows = _plain(conversations)
    return _replayed(rows.select("conv_id").distinct(), rows, True)


def report(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost, audit and digest of the repaired text.

    With ``damage`` the rows are those of :func:`damaged`, and conversations that it leaves without rows stay.
    """
    every = _plain(conversations).select("conv_id").distinct()
    return _replayed(every, _plain(damaged(conversations) if damage else conversations), False)
