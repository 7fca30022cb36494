"""The closest values inside a database that one task holds, against brute force and the joined path."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from querygrove.operators import linking, setjoin

ROW = "db_id string, table_name string, column_name string, value string"


def _grams(text):
    return {text[i:i + 3] for i in range(len(text) - 2)} or {text}


def _rows(seed=7):
    pick = random.Random(seed)
    texts = [f"Customer#{i:05d}" for i in range(40)] + ["", "ab", "é\U0001f600x", "large ring", "large rink", "Large Ring"]
    values = [(f"d{pick.randrange(3)}", pick.choice(["t", "u", None]), "c", pick.choice(texts)) for _ in range(300)]
    values += values[:50] + [("d0", "t", "c", None), (None, "t", "c", "ab"), ("only values", "t", "c", "ab")]
    probes = [(f"d{pick.randrange(3)}", pick.choice(texts)) for _ in range(60)]
    return values, probes + probes[:9] + [("d0", None), (None, "ab"), ("only probes", "ab")]


def _expected(values, probes, limit, percent):
    out = set()
    for db, text in {p for p in probes if None not in p}:
        near = []
        for v in {v for v in values if v[0] == db and v[3] is not None}:
            common, either = len(_grams(text) & _grams(v[3])), len(_grams(text) | _grams(v[3]))
            if common and common * 100 >= either * percent:
                near.append((-(common / either), v[3].encode(), v[1] is not None, v[1] or "", v))
        out |= {(db, text, *v[1:], round(-score, 9)) for score, *_, v in sorted(near, key=lambda n: n[:4])[:limit]}
    return out


@pytest.mark.parametrize("pairs", [linking.PAIRS_PER_TASK, 0, 2500])
def test_closest_values(spark, monkeypatch, pairs):
    """In one task each, all joined, and some of both."""
    monkeypatch.setattr(linking, "PAIRS_PER_TASK", pairs)
    values, probes = _rows()
    found = linking.top_matches(spark.createDataFrame(probes, "db_id string, substring string"), spark.createDataFrame(values, ROW))
    rows = [(r.db_id, r.substring, r.table_name, r.column_name, r.value, round(r.jaccard, 9)) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _expected(values, probes, 10, 45)


def test_long_texts_make_a_database_large(spark, monkeypatch):
    values, probes = spark.createDataFrame(_rows()[0], ROW), spark.createDataFrame(_rows()[1], "db_id string, substring string")
    assert linking._large_databases(values, probes, ("value", "substring")).isEmpty()
    monkeypatch.setattr(linking, "CHARS_PER_TASK", 100)
    assert linking._large_databases(values, probes, ("value", "substring")).count() == 3


def test_runs_of_meetings(monkeypatch):
    """Small runs give the same as one."""
    pick = random.Random(3)
    sets = [pa.chunked_array([pa.array([sorted(pick.sample("abcdefgh", pick.randrange(6))) for _ in range(n)], pa.list_(pa.string()))])
            for n in (50, 70)]
    whole = [x.tolist() for x in setjoin.closest_in_task(*sets, 4, 30)]
    monkeypatch.setattr(setjoin, "MEETINGS", 20)
    assert [x.tolist() for x in setjoin.closest_in_task(*sets, 4, 30)] == whole and len(whole[0]) > 100


def test_pairs_are_not_shuffled_to_find_the_closest(spark):
    """Behind the two sides nothing is dealt again."""
    values = spark.createDataFrame([("d", "t", "c", f"Customer#{i:05d}") for i in range(20)], ROW)
    probes = values.selectExpr("db_id", "value || '7' AS substring")
    plan = linking._closest_in_database(values, probes, 10, 45)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
