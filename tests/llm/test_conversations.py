"""The conversation operators against brute force, on odd rows and on small tables."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from querygrove.llm import prefixes, queries, repair
from querygrove.llm.ropes import join, less, rope, written
from querygrove.llm.ztrie import Path, ZFastTrie, two_fattest

SCHEMA = "conv_id long, turn long, role string, text string, pid string, depth string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(row):
    return (row.turn is not None, row.turn or 0, row.role or "")


@pytest.fixture(scope="module")
def odd_conversations(spark):
    """Nulls in every column, repeated rows, copies, a long conversation, and columns whose names clash."""
    rows = [(5, 0, "user", "hi", "x", "y"), (5, 1, "assistant", "", None, None), (6, None, None, None, "x", None),
            (6, 0, "user", "hi", None, None), (6, 1, "assistant", "yes.", None, None), (None, 0, "user", "lost", None, None),
            (7, 2, "user", "again.", None, None), (7, 2, "user", "again.", None, None), (-3, 0, "system", "S", None, None),
            (-6, 0, "user", "é" * 3, None, None), (20, 0, "user", "long " * 50_000, None, None)]
    rows += [(c, t, "user" if t % 2 else "assistant", f"t{t % 7} ends.", None, None) for c in (11, 12) for t in range(700)]
    rows += [(13, t, "user" if t % 2 else "assistant", f"t{t % 7} ends.", None, None) for t in range(520)]
    rows += [(c, t, "user", f"same {t}.", None, None) for c in range(100, 160) for t in range(3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def no_conversations(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_trie(rows):
    own = defaultdict(list)
    for r in sorted((r for r in rows if r.conv_id is not None), key=key):
        own[r.conv_id].append((r.role or "", r.text or ""))
    trunc = lambda c: c - int(np.fmod(c, 5))
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(trunc(c), [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
        ends[tuple(paths[c])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k],
                   sha(",".join(map(str, ends[k])))) for k, m in members.items())


def ordered(found):
    return sorted(map(tuple, found), key=lambda r: (r[0], r[1], r[7], r[3]))


def test_two_fattest():
    for a in range(40):
        for b in range(a + 1, 70):
            assert two_fattest(a, b) == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_fat_binary_search_finds_every_exit():
    rng = np.random.default_rng(3)

    def path(turns, conv):
        at, x = [0], 0
        for d, t in enumerate(turns):
            x ^= hash((d, t, "x")) & (2 ** 63 - 1)
            at.append(x)
        return Path(0, np.array([[v, v] for v in at], np.int64).tobytes(), [1] * len(turns), ending=[conv])
    for _ in range(30):
        convs = [tuple(rng.integers(0, 2, rng.integers(0, 12))) for _ in range(80)]
        trie = ZFastTrie()
        for s in range(0, 80, 17):
            trie.insert_batch([path(c, s + k) for k, c in enumerate(convs[s:s + 17])])
        nodes, ends = trie.expanded({})
        prefixes_ = {c[:d] for c in convs for d in range(len(c) + 1)}
        assert len(nodes["a"]) == len(prefixes_) == len(set(nodes["a"].tolist()))
        count = {}
        for c in prefixes_:
            count[path(c, 0).key(len(c))] = sum(x[:len(c)] == c for x in convs)
        got = {np.array([a, a]).tobytes(): n for a, n in zip(nodes["a"], nodes["n"])}
        assert got == count and sorted(e[2] for e in ends) == list(range(80))


def test_prefix_trie(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    assert ordered(queries.op11_prefixes(spark, sf_dir).collect()) == ordered(brute_trie(rows))


@pytest.mark.parametrize("segment, held, batch", [(256, 200_000, 4096), (3, 5, 2)])
def test_prefix_trie_of_odd_rows(odd_conversations, no_conversations, monkeypatch, segment, held, batch):
    for name, value in (("SEGMENT", segment), ("HELD", held), ("BATCH", batch)):
        monkeypatch.setattr(prefixes, name, value)
    got = ordered(prefixes.prefix_trie(odd_conversations).collect())
    assert got == ordered(brute_trie(odd_conversations.collect()))
    assert prefixes.prefix_trie(no_conversations).count() == 0


def brute_damage(rows):
    out = []
    for r in rows:
        k = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (r.role, r.text))
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(c for c in text if c not in ".!?")
        if k == 4:
            role = "user"
        out += [(r.conv_id, r.turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def brute_repair(rows):
    """Least (cost, audit) by a table over rows and states, with whole texts in it."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def relax(best):
        for _ in range(3):
            for q, (c, a, out) in list(best.items()):
                for role, name in (("u", "user"), ("a", "assistant")):
                    if q in step[role]:
                        put(best, step[role][q], (c + 2, a + "I", [*out, name + ":"]))

    def put(best, q, new):
        if q not in best or new[:2] < best[q][:2]:
            best[q] = new
    best = {0: (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults):
        relax(best)
        after = {}
        for q, (c, a, out) in best.items():
            put(after, q, (c + 3, a + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if q in step.get(role[:1], {}):
                put(after, step[role[:1]][q], (c + more, a + "K", [*out, f"{role}:{text}"]))
            for kind, name in (("u", "user"), ("a", "assistant")):
                if q in step[kind]:
                    put(after, step[kind][q], (c + 2 + more, a + "R", [*out, f"{name}:{text}"]))
        best = after
    relax(best)
    cost, audit, out = min(best[q] for q in (0, 3) if q in best)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(out)))


def brute_report(rows, order=lambda r: (r[1] is not None, r[1] or 0, r[2])):
    of = {r.conv_id: [] for r in rows if r.conv_id is not None}
    for r in sorted(brute_damage(rows), key=order):
        if r[0] is not None:
            of[r[0]].append(r)
    return sorted((c, *brute_repair(v)) for c, v in of.items())


def test_repair(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    assert sorted(map(tuple, queries.op12_repair(spark, sf_dir).collect())) == brute_report(rows)


def test_repair_of_random_rows(spark):
    rng = np.random.default_rng(12)
    texts, roles = ["Yes.", "No!", "and so on", "", " \n", "What? "], ["system", "user", "assistant", "tool", "", None]
    rows = [(int(c), int(t), roles[int(rng.choice(6, p=[.1, .35, .35, .1, .05, .05]))], f"{texts[rng.integers(0, 6)]}")
            for c in range(150) for t in np.cumsum(rng.integers(1, 3, rng.integers(1, 14)))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, repair.report(frame, damage=True).collect())) == brute_report(frame.collect())


@pytest.mark.parametrize("block, chunk", [(512, 100_000), (3, 10)])
def test_repair_of_odd_rows(spark, odd_conversations, no_conversations, monkeypatch, block, chunk):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = odd_conversations.collect()
    got = sorted(map(tuple, repair.report(odd_conversations, damage=True).collect()))
    assert got == brute_report(rows)
    turns = repair.repaired(odd_conversations).collect()
    digests = {r.conv_id: r.repaired_sha256 for r in repair.report(odd_conversations).collect()}
    for c in digests:
        own = sorted((r.place, f"{r.role}:{r.text}") for r in turns if r.conv_id == c)
        assert digests[c] == sha("\n".join(x for _, x in own))
    assert repair.report(no_conversations, damage=True).count() == repair.repaired(no_conversations).count() == 0


def test_re_pair_restores_every_sequence():
    rng = np.random.default_rng(5)
    given = [rng.integers(0, 3, rng.integers(0, 60)) for _ in range(50)] + [np.zeros(33, np.int64)]
    rules, packed = repair.re_pair(given)

    def open_(symbol):
        return [symbol] if symbol < 16 else [x for part in rules[symbol - 16] for x in open_(part)]
    assert [[x for s in p.tolist() for x in open_(s)] for p in packed] == [g.tolist() for g in given]
    assert sum(map(len, packed)) < sum(map(len, given)) / 2


def test_ropes_compare_as_texts():
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("KD"), rng.integers(0, 9))) * int(rng.integers(1, 30)) for _ in range(60)]

    def cut(t):
        if len(t) < 3:
            return rope(t)
        k = int(rng.integers(1, len(t)))
        return join(cut(t[:k]), cut(t[k:]))
    ropes = [cut(t) for t in texts]
    assert all(less(a, b) == (s < t) for a, s in zip(ropes, texts) for b, t in zip(ropes, texts))
    assert [written(r) for r in ropes] == texts
