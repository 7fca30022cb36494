"""The corpus operators against brute force, on odd rows and on the smallest tables."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from querygrove.llm.common import below_share
from querygrove.llm import langid, licenses, lzprint, mixing, packing, quality, queries, repeats, simhash, toxicity, warc
from querygrove.llm.licence_texts import TEXTS

WIDTH = 100


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def brute_repeats(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - WIDTH + 1):
            w = raw[s:s + WIDTH]
            if w in seen:
                gone[s:s + WIDTH] = b"\1" * WIDTH
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot, hot_rows", [(50_000, 20_000), (1, 20_000), (50_000, 1)])
def test_repeats(spark, sf_dir, hot, hot_rows):
    docs = documents(spark, sf_dir)
    got = sorted(map(tuple, repeats.digest(docs, hot=hot, hot_rows=hot_rows).collect()))
    assert got == brute_repeats([(r.doc_id, r.text) for r in docs.collect()])


def test_repeats_of_random_texts(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(list("ab"), rng.integers(0, 400))) * int(rng.integers(1, 4))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, repeats.digest(docs).collect())) == brute_repeats(rows)


def test_repeats_of_a_passage_in_most_texts(spark):
    rng = np.random.default_rng(4)
    def noise(n):
        return "".join(rng.choice(list("abcdefghijklmnop "), n))
    common = noise(150)
    rows = [(i, noise(int(rng.integers(0, 90))) + common + noise(900)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(repeats.common_grams(docs.select("doc_id", "text"), WIDTH, 200)) > 0
    assert sorted(map(tuple, repeats.digest(docs, hot_rows=200).collect())) == brute_repeats(rows)


def test_repeats_of_odd_rows(spark, odd_docs, no_docs):
    got = repeats.without_repeats(odd_docs)
    assert got.columns == odd_docs.columns and got.count() == odd_docs.count()
    assert sorted(r.text[:8] for r in got.filter("doc_id = 2").collect()) == ["", "", "A second"]
    assert {r.text for r in got.filter("doc_id IS NULL AND kept = 'd'").collect()} == {
        r.text for r in odd_docs.filter("doc_id IS NULL AND kept = 'd'").collect()}
    rng = np.random.default_rng(14)
    rows = [(None if k % 5 == 0 else k // 3, "".join(rng.choice(list("ab"), rng.integers(90, 400)))) for k in range(40)]
    rows += [(i, rows[0][1][:300] + t) for i, t in rows[:9]] + rows[:4]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    want = Counter((order[i][0], *rest) for i, *rest in brute_repeats([(k, t) for k, (_, t) in enumerate(order)]))
    assert Counter(map(tuple, repeats.digest(docs).collect())) == want
    assert repeats.digest(no_docs).count() == 0


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits=4):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= bits):
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()))
    fps = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    expected = brute_components([i for i, _ in rows], fps)
    got = queries.op9_simhash(spark, sf_dir).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{int(f):016x}" for (i, _), f in zip(rows, fps)}


def test_split_shards_lose_no_link(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2 ** 63, 3, np.uint64)
    fps = np.unique(np.array([int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))
                              for c in centre for _ in range(120)], np.uint64))
    table = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long").cache()
    for rows in (10_000, 100):
        edges = simhash.links(table, shard_rows=rows)
        found = {r.node: r.root for r in simhash.components(edges).collect()}
        signed = [int(f) for f in fps.view(np.int64)]
        expected = brute_components(signed, fps)
        assert {k: found.get(k, k) for k in signed} == expected


def test_tree_links_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 63, 40, np.uint64)
    points = np.unique(base[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (40, 8)).astype(np.uint64)))
    pairs = {tuple(sorted(p)) for i, j in simhash.tree_links(points, points[:0], 4) for p in zip(i.tolist(), j.tolist())}
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None]) <= 4)
    assert pairs == {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a < b}


def test_simhash_of_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd_docs).collect()}
    assert got[4] == got[5] == 3 and got[2] == 1
    kept = simhash.kept_of_groups(odd_docs).collect()
    assert sorted(
        (r.doc_id, r.text[:8]) for r in kept if r.doc_id in (1, 2)) == [(1, "One two "), (2, "A second")]
    assert [r.kept for r in kept if r.doc_id is None and r.kept] == ["d"]
    assert simhash.near_duplicates(no_docs).count() == 0


def brute_quality(text):
    words = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    counts = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if counts[tuple(words[k:k + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def test_quality(spark, sf_dir):
    texts = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    for r in queries.op6_quality(spark, sf_dir).collect():
        n, *_, repeated = expected = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n)
        assert not (r.kept and r.base_failed)


def test_quality_distances(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), " ".join(["word", "of", "text"][j] for j in rng.integers(0, 3, rng.integers(60, 200))))
            for k in range(300)]
    rows += [(1000 + k, " ".join(f"a{j}|" for j in range(50))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn(
        "source", F.lit("s"))
    got = {r.row.doc_id: r for r in quality.verdicts(docs, ["doc_id"]).collect()}
    assert not any(got[1000 + k].kept for k in range(20))
    clean = [r for i, r in got.items() if i < 1000 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)


def test_quality_of_odd_rows(odd_docs, no_docs):
    assert quality.accepted(odd_docs).columns == odd_docs.columns
    assert quality.verdicts(odd_docs, ["doc_id"]).count() == odd_docs.count()
    assert quality.accepted(no_docs).count() == 0


def brute_budget(node, share, weights, depth=0):
    """Shares of the leaves below ``node`` (a dict of dicts, leaves are rooms)."""
    def room(n):
        return n if isinstance(n, int) else sum(map(room, n.values()))
    names, left, w = sorted(node), share, {k: weights[depth].get(k, 1) for k in node}
    given, open_ = {}, set(names)
    while True:
        total = sum(w[k] for k in open_)
        full = {k for k in open_ if room(node[k]) * total <= left * w[k]}
        if not full:
            given |= {k: left * w[k] // total for k in open_}
            break
        for k in full:
            given[k] = room(node[k])
            left -= given[k]
        open_ -= full
        if not open_:
            break
    out = {}
    for k in names:
        if isinstance(node[k], int):
            out[(k,)] = given[k]
        else:
            out |= {(k, *rest): v for rest, v in brute_budget(node[k], given[k], weights, depth + 1).items()}
    return out


def test_budgets(spark):
    tree = {"a": {"x": {"s": 100, "t": 10}, "y": {"s": 5}}, "b": {"x": {"s": 1000}}, "c": {"x": {"s": 1, "t": 2}}}
    leaves = [(d, la, s, n) for d, v in tree.items() for la, u in v.items() for s, n in u.items()]
    weights = {"domain": {"a": 3}, "lang": {"x": 2}, "source": {"t": 4}}
    for share in (0, 30, 150, 400, 5000):
        got = mixing.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"),
                             F.lit(share), 1, weights)
        expected = brute_budget(tree, min(share, 1118), [weights[k] for k in mixing.LEVELS])
        assert {(r.domain, r.lang, r.source): r.share for r in got.collect()} == expected


def test_mix_takes_its_shares(spark, sf_dir):
    docs = documents(spark, sf_dir)
    taken = mixing.mix(docs).toPandas()
    leaves = taken.groupby(["domain", "lang", "source"])[["n_tokens", "taken_tokens"]].sum().reset_index()
    frame = spark.createDataFrame(leaves.rename(columns={"n_tokens": "tokens"})[["domain", "lang", "source", "tokens"]])
    shares = mixing.budgets(frame, F.lit(int(leaves.n_tokens.sum()) * mixing.BUDGET_PERCENT // 100),
                            mixing.MAX_EPOCHS, mixing.WEIGHTS).collect()
    assert {(r.domain, r.lang, r.source): r.share for r in shares} == {
        (r.domain, r.lang, r.source): r.taken_tokens for r in leaves.itertuples()}
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    words = rows.select(F.sum(F.size(mixing.words(F.col("text"))))).first()[0]
    assert words == taken.taken_tokens.sum()


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    assert mixing.mix(odd_docs).count() == odd_docs.count()
    for texts in (["a b c d e"] * 10, [f"a b c d {k}" for k in range(10)]):
        docs = spark.createDataFrame([(None, t, "en", "s") for t in texts], "doc_id long, text string, lang string, source string")
        shares = [r.taken_tokens for r in mixing.mix(docs, budget_percent=66).collect()]
        assert sum(shares) == 33 and sorted(shares) == [0] * 3 + [3] + [5] * 6
        assert mixing.mixed(docs, budget_percent=66).select(F.sum(F.size(F.split("text", " ")))).first()[0] == 33
    assert mixing.mixed(odd_docs).columns == odd_docs.columns
    assert mixing.mix(no_docs).count() == 0


def brute_best_fit(pieces, capacity):
    bins, out = [], []
    for n, source, cluster in pieces:
        fits = [(capacity - b[0], k) for k, b in enumerate(bins)
                if b[0] + n <= capacity and not b[1] & source and not b[2] & cluster]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([0, 0, 0])
        bins[k] = [bins[k][0] + n, bins[k][1] | source, bins[k][2] | cluster]
        out.append(k)
    return out


def test_best_fit():
    rng = np.random.default_rng(4)
    for _ in range(200):
        pieces = [(int(rng.integers(1, 90)), 1 << int(rng.integers(0, 6)), int(rng.integers(0, 2)) << int(rng.integers(0, 9)))
                  for _ in range(150)]
        assert packing.best_fit(pieces, 100) == brute_best_fit(pieces, 100)


def test_packing(spark, sf_dir, odd_docs, no_docs):
    docs = documents(spark, sf_dir)
    got = packing.pack(docs).toPandas()
    sizes = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == {k: v for k, v in sizes.items() if v}
    assert (got.groupby("bin_id").n_tokens.sum() <= packing.CAPACITY).all()
    assert not got.duplicated(["bin_id", "source"]).any()
    assert packing.pack(odd_docs).count() > 0 and packing.pack(no_docs).count() == 0


def test_automaton_parses_greedily():
    rng = np.random.default_rng(6)
    sample = rng.integers(0, 4, 300).astype(np.uint8)
    table = langid.automaton(sample)
    raw = sample.tobytes()

    def greedy(text):
        count, k = 0, 0
        while k < len(text):
            e = k + 1
            while e < len(text) and text[k:e + 1].tobytes() in raw:
                e += 1
            count, k = count + 1, e
        return count
    texts = [rng.integers(0, 5, n).astype(np.uint8) for n in (1, 7, 90, langid.BLOCK, 0, 1000, 2 * langid.BLOCK)]
    texts += [np.r_[4, 4, sample[:200]], np.tile([4, 0], 600), np.tile(sample, 4), np.full(700, 4)]
    texts = [np.asarray(t, np.uint8) for t in texts]
    assert langid.parse(texts, [table])[:, 0].tolist() == [greedy(t) for t in texts]


def test_language_sample_counts_copies_once(spark):
    rows = [(k, "one text of many copies", "aa") for k in range(20_000)] + [
        (30_000 + k, f"another text number {k}", "aa") for k in range(20)] + [(50_000, "andere Sprache", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = below_share(docs, "lang", F.xxhash64("text"), 48).select("text").distinct().count()
    assert kept == 22 and langid.fit(docs)["langs"] == ["aa", "bb"]


def test_language(spark, sf_dir, odd_docs, no_docs):
    docs = documents(spark, sf_dir)
    joined = queries.op1_language(spark, sf_dir).join(docs, "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in joined) >= 0.95 * len(joined)
    assert {r.doc_id: r.lang_pred for r in langid.held_out_predictions(odd_docs).collect()}[4] == "und"
    assert langid.held_out_predictions(no_docs).count() == 0


def test_licenses(odd_docs, no_docs, spark):
    texts = ["CC-BY, cc by; General Public License.", "x all rights\nreserved all rights reserved", "cc-bye by",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software!", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (3, 0, 4, "cc-by,gpl")
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (2, 1, 4)
    assert got[2].n_base == 0 and got[2].first_word is None and got[2].labels == ""
    assert got[3].labels == "mit" and got[3].score == 1.0 and got[3].spans[0].end == 16
    assert got[4].n_words == 0
    assert licenses.scan(odd_docs).count() == odd_docs.count() and licenses.scan(no_docs).count() == 0


def test_whole_licence_texts(spark):
    # As files carry them: comment marks, other line ends, capitals, a holder's name in a disclaimer.
    marked = {label: " * " + text.replace("\n", "\n * ").upper() for label, text in TEXTS}
    marked["bsd"] = marked["bsd"].replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "JANE DOE")
    plain = "the terms of the software and the use of this software with the license in the public domain " * 20
    cut = " ".join(dict(TEXTS)["zlib"].split()[:60])
    docs = spark.createDataFrame(list(enumerate([*marked.values(), plain, cut])), "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) - {""} for r in licenses.scan(docs).collect()}
    for k, label in enumerate(marked):
        assert label in got[k] and got[k] <= {label, "bsd", "mit", "gpl", "apache-2.0"} - ({"isc", "zlib"} - {label}), label
    assert got[len(marked)] == set() and got[len(marked) + 1] == set()


def test_each_language_has_its_alphabet(spark):
    rng = np.random.default_rng(3)
    alphabets = {"la": "abcdefghijklmnopqrstuvwxyz", "el": "αβγδεζηθικλμνξοπρστυφχψω", "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 400)))}

    def text(lang, seed):
        own = np.random.default_rng([len(lang), ord(lang[0]), seed % 7])
        vocabulary = ["".join(own.choice(list(alphabets[lang]), 4)) for _ in range(30)]
        return " ".join(rng.choice(vocabulary, 60))
    rows = [(k, text(lang, k), lang) for k, lang in enumerate(["la", "el", "zh"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    for lang, table in zip(model["langs"], model["alphabets"]):
        other = next(a for name, a in alphabets.items() if name != lang)
        assert {int(table[ord(c)]) for c in other} == {1}  # letters that the language lacks are no frequent ones
    assert max(model["alphabets"][2].tolist()) <= langid.LETTERS + 1
    new = spark.createDataFrame([(k, text(lang, k), lang) for k, lang in enumerate(["zh", "la", "el"] * 5)] + [(99, "ЖЖЖЖ", "?")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(new, model).collect()}
    assert [got[k].lang_pred for k in range(15)] == ["zh", "la", "el"] * 5
    assert got[99].lang_pred in alphabets and 0 <= got[99].score <= 1


def test_language_sample_takes_spans_of_whole_texts(spark):
    rows = [(k, "x" * 3000 + f" {k} " + "omega" * 800, "aa") for k in range(30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["alphabets"][0][ord("g")] > 1  # a prefix of 1,500 characters has none


def test_license_matches_are_longest():
    auto = licenses.Automaton([list("abcab"), list("cabd"), list("bb")])
    whole = ["abcab", "cabd", "bb"]
    text = "xabcabdbbac"
    for end, length, _ in auto.matches(list(text)):
        assert any(text[end - length:end] in w for w in whole)
        assert end - length == 0 or not any(text[end - length - 1:end] in w for w in whole)


def test_fingerprints(spark, sf_dir, odd_docs, no_docs):
    rows = documents(spark, sf_dir).orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op7_fingerprints(spark, sf_dir).collect()}
    for k, r in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)].text, len(r.text) // 2
        edited = r.text[:len(r.text) - half] + after[:half]
        assert got[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[r.doc_id].edited_fingerprint == lzprint.signature(edited).tobytes().hex()
        assert got[r.doc_id].near_next == lzprint.likeness(lzprint.signature(r.text), lzprint.signature(after))
    assert lzprint.compare_with_edits(odd_docs).count() == odd_docs.count()
    assert lzprint.compare_with_edits(no_docs).count() == 0


def brute_phrases(text):
    phrases, k = [], 0
    while k < len(text):
        e = k + 1
        while e < len(text) and text[k:e] in phrases:
            e += 1
        phrases.append(text[k:e])
        k = e
    return set(phrases)


def brute_print(phrases):
    mask, base, least = (1 << 64) - 1, 0x9E3779B97F4A7C15, {}
    for p in phrases:
        x = sum((ord(c) + 1) * pow(base, k, 1 << 64) for k, c in enumerate(p)) & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        x ^= x >> 31
        least[x >> 57] = min(least.get(x >> 57, mask), x)
    return [min(least[k] >> 41 & 0xFFFF, 0xFFFE) if k in least else 0xFFFF for k in range(128)]


def test_fingerprints_against_brute_force(spark, sf_dir):
    texts = [r.text for r in documents(spark, sf_dir).orderBy("doc_id").limit(60).collect()]
    texts += ["", "a", "é" * 300, "\U0001F600x" * 50]
    errors = []
    for a, b in zip(texts, texts[1:]):
        half = len(a) // 2
        edited = a[:len(a) - half] + b[:half]
        x, y = brute_phrases(a), brute_phrases(edited)
        read = lzprint.Parsed(a)
        assert read.fingerprint.tolist() == lzprint.signature(a).tolist() == brute_print(x)
        made, fp = read.edited(b)
        assert made == edited and fp.tolist() == brute_print(y)
        errors.append(abs(lzprint.likeness(read.fingerprint, fp) - (len(x & y) / len(x | y) if x | y else 1)))
    assert max(errors) < 0.2 and np.mean(errors) < 0.05


def test_texts_without_blanks_are_alike():
    rng = np.random.default_rng(12)
    text = "".join(rng.choice(list("abcdefgh"), 2_000))
    assert lzprint.likeness(lzprint.signature(text), lzprint.signature(text[:1_000] + "z" + text[1_001:])) > 0.6


def test_likeness_follows_phrase_sets():
    rng = np.random.default_rng(9)
    a = [f"w{k}" for k in rng.integers(0, 3000, 4000)]
    b = a[:3000] + [f"v{k}" for k in range(1000)]
    x, y = (set(lzprint.phrase_hashes(" ".join(t)).tolist()) for t in (a, b))
    near = lzprint.likeness(lzprint.signature(" ".join(a)), lzprint.signature(" ".join(b)))
    assert abs(near - len(x & y) / len(x | y)) < 0.3


def test_toxicity(spark, odd_docs, no_docs):
    rng = np.random.default_rng(8)
    plain = [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    def text(bad):
        words = [plain[k] for k in rng.integers(0, len(plain), 80)]
        return " ".join(words[:40] + ["grumbler"] * bad + words[40:])
    y = [k % 4 == 0 for k in range(300)]
    weight, bias = toxicity.train([text(b) for b in y], [int(b) for b in y])
    good, bad = toxicity.margins([text(0)] * 3, weight, bias), toxicity.margins([text(0) + " grumbla"] * 3, weight, bias)
    assert bad.min() > good.max()
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.held_out_scores(odd_docs, labels).count() == odd_docs.count()
    assert toxicity.held_out_scores(no_docs, labels).count() == 0


def test_toxicity_reads_all_parts_of_labelled_texts(spark):
    late = "filler " * 3_000 + "grumbler " * 300
    rows = [("short grumbler",), (late,), ("",), (None,)]
    got = spark.createDataFrame(rows, "text string").select(toxicity.sampled(F.col("text")).alias("t")).collect()
    assert [got[0].t, got[2].t, got[3].t] == ["short grumbler", "", ""]
    spans = got[1].t.split("\n")
    assert [len(x) for x in spans] == [toxicity.SPAN_CHARS] * toxicity.SPANS and all(x in late for x in spans)
    assert "grumbler" in spans[-1]


def test_toxicity_of_misspellings(spark):
    rng = np.random.default_rng(18)
    plain = [f"{a}{b}{c}el" for a in "bcdfgh" for b in "aeiou" for c in "lmnr"]
    def text(k):
        own = [plain[j] for j in rng.integers(0, len(plain), 60)]
        return " ".join(own[:30] + (["grumbl3rs"] if k % 3 == 0 else []) + own[30:])
    rows = [(k, text(k)) for k in range(900)] + [(1_000 + k, text(1).replace(" ", f" {w} ", 1)) for k, w in
                                                 enumerate(["grumbl3r", "gruumbl3rs", "GRUMBL3RS", "agrumbl3rs"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(900)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.held_out_scores(docs, labels).collect()}
    held = [k for k in range(900) if got[k].held_out]
    assert sum(got[k].predicted == (k % 3 == 0) for k in held) >= 0.97 * len(held) > 0
    assert [got[1_000 + k].predicted for k in range(4)] == [1] * 4


def test_warc_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x &lt; y</p><script>no</script>"), (2, None, None)],
                                  "page_id long, url string, html string")
    made = warc.derivatives(warc.responses(pages)).collect()
    assert len(made) == 4 and {r.block for r in made if r.record_type == "conversion"} == {"x < y", ""}
    for r in made:
        head, block = r.record.split("\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(block.encode())
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block.encode()).hexdigest()
        assert fields["WARC-Refers-To"] == r.refers_to
    warc.write(warc.derivatives(warc.responses(pages)), str(tmp_path / "out"))


def test_pipeline(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and got.agg(F.max("bin_tokens")).first()[0] <= packing.CAPACITY
