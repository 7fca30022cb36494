"""The secret scan against patterns written out again, and its tests on random and ordinary tokens."""

import hashlib
import re

import numpy as np
import pytest

from querygrove.llm import queries, secrets

PATTERNS = [("assign", r"""(?ai:(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?)([A-Za-z0-9+/_.=-]+)"""),
            ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            size = len(m.group(1)) if kind == "assign" else m.end() - m.start()
            if size >= (6, 20, 24)[k]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


def expected(doc_id, text):
    base = brute_base(text)
    return (doc_id, *[sum(x.startswith(k + ":") for x in base) for k, _ in PATTERNS],
            hashlib.sha256(",".join(base).encode()).hexdigest())


def check(rows, got):
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted((expected(r.doc_id, r.text) for r in rows), key=repr)
    base = {kind for kind, _ in PATTERNS}
    for r in got:
        own = [s for s in r.spans.split(",") if s and s.split(":")[0] in base]
        assert hashlib.sha256(",".join(own).encode()).hexdigest() == r.base_sha256
        places = [(int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0])) for s in r.spans.split(",") if s]
        assert places == sorted(places)


def test_secrets(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), queries.op13_secrets(spark, sf_dir).collect())


def test_secrets_of_odd_texts(spark, odd_docs, no_docs):
    texts = ["é" * 5 + "API_KEY = 'abc.def-1' toKen:xyz", "Kſecret=abcdefg ſecret=abcdefg", "AKIAAKIA AKIA" + "A1" * 9 + " AKIA" + "B" * 15,
             "x" + "0f" * 12 + "g" + "0f" * 11, "password= token=abcdef12 secret : \"short\" passwd='=====''", "token = token = abcdefgh", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs.collect(), secrets.digest(docs).collect())
    check(odd_docs.collect(), secrets.digest(odd_docs).collect())
    assert secrets.digest(no_docs).count() == 0


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    words = ["".join(w) for w in (["en", "er", "ch", "lich", "ung", "tion", "ou", "the", "ing"][i] for i in range(9))]
    rows = []
    for k in range(1500):
        long = "".join(words[i] for i in rng.integers(0, 9, 12))
        rows.append((k, f"plain words {long} {long.upper()} some_long_identifier_of_{words[k % 9]}_code ./usr/lib/{long[:9]}/share/doc"))
    for k in range(60):
        kind = list(secrets.ENCODINGS)[k % 7]
        token = "".join(rng.choice(list(secrets.ENCODINGS[kind]), 64))
        rows.append((2000 + k, f"é see {token} here"))
    return rows


def test_random_tokens_are_found_and_words_are_not(spark, planted):
    got = secrets.digest(spark.createDataFrame(planted, "doc_id long, text string")).collect()
    wrong = [r for r in got if r.doc_id < 2000 and "random" in r.spans]
    right = [r for r in got if r.doc_id >= 2000 and ":6:70" in r.spans and "random" in r.spans]
    assert len(wrong) <= 2 and len(right) >= 57


def test_discoveries_are_controlled():
    # All p-values uniform: no more than the rate is expected to pass; with signals they pass.
    rng = np.random.default_rng(2)
    def table(p):
        bins = np.minimum((-np.log10(p) / secrets.BIN_WIDTH).astype(int), secrets.BINS)
        values, counts = np.unique(bins, return_counts=True)
        return [(3, 8, int(b), int(n)) for b, n in zip(values, counts)]
    false = [sum(n for *_, b, n in table(p) if b >= secrets.limits(table(p))[3, 8]) > 0
             for p in (rng.random(2000) for _ in range(200))]
    assert np.mean(false) < 0.05
    mixed = table(np.r_[rng.random(2000), np.full(100, 1e-9)])
    assert 99 <= sum(n for *_, b, n in mixed if b >= secrets.limits(mixed)[3, 8]) <= 106
    assert secrets.limits([(3, 8, 5, 10)])[3, 8] > secrets.BINS
