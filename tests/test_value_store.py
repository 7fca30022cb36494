"""The growing value store against all pairs, batch by batch, and its plans and files."""

import random
import re

from querygrove.functions import minhash
from querygrove.operators import linking, value_store
from pyspark.sql import functions as F

VALUES = "db_id string, table_name string, column_name string, value string"


def some_values(n, seed):
    rng = random.Random(seed)
    words = ["red", "green", "blue", "widget", "wagon", "gear", "gearbox", "x", ""]
    return [(rng.choice("de"), "t", rng.choice("ab"), " ".join(rng.choice(words) for _ in range(rng.randrange(4)))) for _ in range(n)]


def shingles(text):
    return {text[i:i + 3] for i in range(len(text) - 2)} or {text}


def test_store_grows_and_finds_every_near_value(spark, tmp_path):
    batches = [some_values(60, 1), some_values(60, 2) + some_values(20, 1), [("f", "t", "a", "green gearbox"), ("d", "t", "a", None)]]
    path = str(tmp_path / "store")
    store = value_store.created(spark.createDataFrame(batches[0], VALUES), path, buckets=4, parts=3)
    for batch in batches[1:] + batches[:1]:  # the first one comes again
        value_store.merge(value_store.opened(spark, path), spark.createDataFrame(batch, VALUES))
    held = {v for batch in batches for v in batch if v[3] is not None}
    assert {tuple(r) for r in spark.table(store.values()).select("db_id", "table_name", "column_name", "value").collect()} == held
    assert spark.table(store.values()).count() == len(held)
    probes = [(d, p) for d in "defg" for p in ("red widget", "green gear", "x", "", "wagons", "green gearbox")]
    asked = spark.createDataFrame(probes + probes[:2], "db_id string, substring string")
    smaller = value_store.compacted(store, str(tmp_path / "compact"))
    for percent in (45, 80, 100):
        want = {(d, p, *v[1:]) for d, p in probes for v in held if v[0] == d and
                100 * len(shingles(p) & shingles(v[3])) >= percent * len(shingles(p) | shingles(v[3]))}
        for one in (store, smaller, value_store.opened(spark, smaller.path)):
            rows = value_store.near(one, asked, percent).collect()
            assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    assert len(list((tmp_path / "store" / "postings").glob("*.parquet"))) <= 4 * 4
    assert len(list((tmp_path / "compact" / "postings").glob("*.parquet"))) <= 4


def test_probes_do_not_shuffle_the_store(spark, tmp_path):
    store = value_store.created(spark.createDataFrame(some_values(50, 3), VALUES), str(tmp_path / "store"), buckets=16)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = value_store.near(store, spark.createDataFrame([("d", "red")], "db_id string, substring string"), 60)
        lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    depth = [re.search(r"[A-Z]", line).start() if re.search(r"[A-Z]", line) else 0 for line in lines]
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "value_store" in line]
    assert len(scans) == 2
    for i in scans:  # the operators above a scan, up to the join
        at, above = depth[i], []
        for j in range(i - 1, -1, -1):
            if depth[j] < at:
                at = depth[j]
                above.append(lines[j])
                if "Join" in lines[j]:
                    break
        assert "Join" in above[-1] and not any("Exchange" in line for line in above)


def test_store_refuses_what_it_was_not_laid_out_for(spark, tmp_path):
    store = value_store.created(spark.createDataFrame([], VALUES), str(tmp_path / "store"), buckets=2)
    probes = spark.createDataFrame([("d", "red")], "db_id string, substring string")
    assert value_store.near(store, probes, 80).count() == 0
    try:
        value_store.near(store, probes, 10)
        raise AssertionError("a lower similarity must be refused")
    except ValueError:
        pass


def test_bounded_distance_keeps_the_same_pairs(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abAB é") for _ in range(rng.randrange(12)))
    pairs = spark.createDataFrame([(text(), text()) for _ in range(400)], "substring string, similar_value string")
    full = linking.levenshtein_similarity(F.col("substring"), F.col("similar_value"))
    for threshold in (0.3, 0.5, 0.75, 1.0):
        want = sorted(map(tuple, pairs.withColumn("s", full).filter(F.col("s") >= threshold).collect()))
        assert sorted(map(tuple, linking.edit_filter(pairs, threshold).collect())) == want


def test_refine_by_steps(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(6) if rng.random() < 0.6 else 1, f"v{i}", rng.randrange(5, 11) / 10, rng.randrange(10, 21) / 20) for i in range(300)]
    rows += [(7, "only", 0.4, 0.7), (8, "no vector", 0.9, None), (8, "vector", 0.5, 0.9)]
    got = linking.refine(spark.createDataFrame(rows, "g int, similar_value string, edit_similarity double, embedding_similarity double"), ["g"])
    want = set()
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        near = [r for r in mine if r[2] >= 0.9 * max(r[2] for r in mine)]
        scores = [r[3] for r in near if r[3] is not None]
        want |= {r[:2] for r in near if r[3] is not None and r[3] >= 0.9 * max(scores)}
    kept = got.collect()
    assert {(r.g, r.similar_value) for r in kept} == want and len(kept) == len(want)


def test_probe_ranks(spark):
    probes = linking.probe_strings(spark.createDataFrame([("d", "ab cd"), ("d", "k = abc")], "db_id string, keyword string"))
    ranked = linking.ranked_probes(probes).orderBy("keyword", "probe_rank").collect()
    assert [r.substring for r in ranked if r.keyword == "ab cd"] == ["ab cd", "cd", "ab"]
    lengths = [len(r.substring) for r in ranked if r.keyword != "ab cd"]
    assert lengths == sorted(lengths, reverse=True)


def test_index_files_are_bounded(spark, tmp_path):
    rows = [(f"d{i % 3}", "t", "c", f"v{i}") for i in range(300)]
    index = spark.createDataFrame(rows, VALUES).repartition(16).withColumn("value_id", F.md5("value")).withColumn(
        "signature", minhash.signature(F.col("value")))
    linking.write_index(index, str(tmp_path / "index"))
    for folder in (tmp_path / "index").glob("db_id=*"):
        assert len(list(folder.glob("*.parquet"))) <= linking.FILES_PER_DATABASE
    assert linking.read_index(spark, str(tmp_path / "index"), ["d1"]).count() == 100
