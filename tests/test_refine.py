"""Refinement in as many tasks as its rows ask for."""

from __future__ import annotations

import random

from querygrove.operators import linking

SCHEMA = "g int, similar_value string, edit_similarity double, embedding_similarity double"


def _expected(rows):
    kept = []
    for g in {r[0] for r in rows if r[0] is not None}:
        mine = [r for r in rows if r[0] == g]
        top = max(r[2] for r in mine if r[2] is not None)
        near = [r for r in mine if r[2] is not None and r[2] >= 0.9 * top]
        best = max((r[3] for r in near if r[3] is not None), default=None)
        kept += [r for r in near if best is not None and r[3] is not None and r[3] >= 0.9 * best]
    return sorted(kept)


def test_tasks_follow_the_rows(spark, monkeypatch):
    """Rows that repeat, nulls and a hot group, with more tasks than the session has shuffle partitions."""
    rng = random.Random(5)
    rows = [(0 if i % 3 == 0 else rng.randrange(40), f"v{i % 200}", rng.randrange(1, 51) / 50, 1 - rng.randrange(11) / 20) for i in range(900)]
    rows += rows[:50] + [(None, "n", 1.0, 1.0), (3, "n", None, 1.0), (4, "n", 1.0, None)]
    entities = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(linking, "STEP_ROWS", 10)
    tasks = -(-len(rows) // 10)
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = linking.refine(entities, ["g"])
    assert sorted(tuple(r) for r in found.collect()) == _expected(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and all(f", {tasks})" in line for line in dealt), plan


def test_few_rows_are_left_to_spark(spark):
    rows = [(g, f"v{i}", i / 10, 1 - i / 20) for g in range(5) for i in range(1, 9)]
    found = linking.refine(spark.createDataFrame(rows, SCHEMA), ["g"])
    assert sorted(tuple(r) for r in found.collect()) == _expected(rows)
    assert "REPARTITION_BY_NUM" not in found._jdf.queryExecution().executedPlan().toString()
