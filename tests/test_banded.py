"""Pairs by shared bands: all of them, with what their signatures estimate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from querygrove.functions import minhash
from querygrove.operators import joins, linking
from querygrove.session import write_and_read

VALUES = [("d1", "t", "c", f"Customer#{i:09d}") for i in range(60)] + [("d2", "t", "c", "Customer#000000001"), ("d1", "u", "c", "")]
PROBES = [("d1", f"Customer#{i:09d}") for i in (3, 77, 512)] + [("d1", "Customer"), ("d1", "")]


def _sides(spark):
    values = spark.createDataFrame(VALUES, "db_id string, table_name string, column_name string, value string")
    probes = spark.createDataFrame(PROBES, "db_id string, substring string")
    return linking.probe_index(probes), linking.value_index(values)


def test_every_pair_that_shares_a_band(spark):
    probes, index = _sides(spark)
    left, right = probes.collect(), index.collect()
    expected = {(p.db_id, p.substring, v.table_name, v.column_name, v.value): sum(
        a == b for a, b in zip(p.probe_signature, v.signature)) / minhash.PERMUTATIONS
        for p in left for v in right if p.db_id == v.db_id and set(p.probe_bands) & set(v.bands)}
    found = linking.lsh_candidates(probes, index)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == set(expected)
    assert any(share < 0.7 for share in expected.values())  # pairs that are no near ones
    assert {tuple(r)[:-1]: r.estimated_jaccard for r in linking.estimated(found).collect()} == expected


def test_estimates_when_kept_signatures_run_out(spark, monkeypatch):
    monkeypatch.setattr(minhash, "KEPT_SIGNATURES", 3)
    pairs = spark.range(50).select(F.concat(F.lit("name "), F.col("id")).alias("a"), F.concat(F.lit("name "), F.col("id") % 7).alias("b"))
    both = pairs.select(minhash.estimated_of_texts(F.col("a"), F.col("b")).alias("x"), minhash.estimated_jaccard(
        minhash.signature(F.col("a")), minhash.signature(F.col("b"))).alias("y")).collect()
    assert [r.x for r in both] == [r.y for r in both]


def test_spread_keeps_its_count_behind_a_distinct(spark):
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(100).select(F.col("id").cast("string").alias("k")).distinct()
    assert joins.spread(rows, "k").select(F.spark_partition_id().alias("p")).distinct().count() == partitions > 1


def test_no_signature_in_a_shuffle_of_pairs(spark):
    probes, index = _sides(spark)
    plan = linking.estimated(linking.lsh_candidates(probes, index))._jdf.queryExecution().toString()
    assert "signature" not in plan


def test_pairs_of_small_databases_are_not_shuffled(spark):
    """Every database goes whole to one task, so behind the two sides nothing is dealt again."""
    names = [(f"shop{d}", "t", "c", f"Customer#{i:09d}") for d in range(40) for i in range(12)]
    values = spark.createDataFrame(names, "db_id string, table_name string, column_name string, value string")
    probes = values.filter("value LIKE '%1'").select("db_id", F.concat("value", F.lit("7")).alias("substring"))
    probes, index = linking.probe_index(probes), linking.value_index(values)
    expected = {(p.db_id, p.substring, v.value) for p in probes.collect() for v in index.collect()
                if p.db_id == v.db_id and set(p.probe_bands) & set(v.bands)}
    found = linking.lsh_candidates(probes, index)
    rows = [(r.db_id, r.substring, r.value) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected and len(expected) > 40
    sides = write_and_read(index, "values"), write_and_read(probes, "probes")
    plan = linking.estimated(linking._pairs_in_database(*sides))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "FlatMapCoGroups" in plan, plan


def test_large_databases_meet_by_band(spark, monkeypatch):
    """Databases of both kinds in one call; null databases meet nothing."""
    names = [(f"shop{d}", "t", "c", f"Customer#{i:09d}") for d in range(30) for i in range(200 if d == 0 else 4)] + [(None, "t", "c", "Customer#000000001")]
    values = spark.createDataFrame(names, "db_id string, table_name string, column_name string, value string")
    probes = values.filter("value LIKE '%1'").select("db_id", F.concat("value", F.lit("7")).alias("substring"))
    probes, index = linking.probe_index(probes), linking.value_index(values)
    monkeypatch.setattr(linking, "PAIRS_PER_TASK", 100)
    large = linking._large_databases(index, probes)
    assert [r.db_id for r in large.collect()] == ["shop0"]
    expected = {(p.db_id, p.substring, v.value) for p in probes.collect() for v in index.collect()
                if p.db_id and p.db_id == v.db_id and set(p.probe_bands) & set(v.bands)}
    rows = [(r.db_id, r.substring, r.value) for r in linking.lsh_candidates(probes, index).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    assert {d for d, *_ in rows} == {f"shop{d}" for d in range(30)}


def test_shared_bands_in_runs(monkeypatch):
    """Pairs do not depend on how many meetings are looked at together; empty sides share nothing."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, (40, 4)), rng.integers(0, 9, (30, 4))
    expected = {(i, j) for i in range(40) for j in range(30) if set(a[i]) & set(b[j])}
    kind = pa.list_(pa.int64())
    sides = [pa.chunked_array([x[:11].tolist(), x[11:].tolist()], kind) for x in (a, b)]
    for meetings in (1, 50, 10**6):
        monkeypatch.setattr(linking, "MEETINGS", meetings)
        left, right = linking.shared_bands(*sides)
        assert len(left) == len(expected) and set(zip(left.tolist(), right.tolist())) == expected
    none = pa.chunked_array([[]], kind)
    for pair in ((none, sides[1]), (sides[0], none), (none, none)):
        assert [len(x) for x in linking.shared_bands(*pair)] == [0, 0]
