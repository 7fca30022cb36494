"""Counts by digest and the bounded categorical test against plain counting."""

import random

import pytest

from querygrove.operators import profiling


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    wide = [(rng.choice([None, "", "a", "b "]), rng.randrange(19), rng.randrange(20), rng.choice([0.0, -0.0, None, 1.5]),
             f"v{rng.randrange(33)}", i, None) for i in range(5000)]
    kinds = "few string, nineteen int, twenty int, zero double, more string, every long, empty string"
    nested = [([1, 2], {"k": 1}), ([1, 2], {"k": 1}), (None, None), ([], {"k": 2})]
    return {"wide": spark.createDataFrame(wide, kinds).repartition(7),
            "nested": spark.createDataFrame(nested, "l array<int>, m map<string,int>"),
            "none": spark.createDataFrame([], "x string, `y.z` int")}


def brute(tables):
    out = {}
    for t, df in tables.items():
        rows = df.collect()
        for k, field in enumerate(df.schema.fields):
            cells = [r[k] for r in rows]
            seen = {repr(c + 0.0 if isinstance(c, float) else c) for c in cells if c is not None}
            out[t, field.name] = (sum(c is not None for c in cells), len(seen), sum(c is None for c in cells))
    return out


def test_counts_by_digest(tables):
    got = {(r.table_name, r.column_name): (r.n_nonnull, r.n_distinct, r.n_null)
           for r in profiling.counts_of_tables(tables, "d").collect()}
    assert got == brute(tables)


def test_no_cell_is_shuffled(tables):
    plan = profiling.digest_counts(tables)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("few" not in line and "value" not in line for line in exchanges)


def test_categorical_by_sketch(tables):
    got = {(r.table_name, r.column_name): r.is_categorical for r in profiling.few_values(tables, "d").collect()}
    assert got == {k: d + (n > 0) < 20 for k, (_, d, n) in brute(tables).items()}


def test_profile_names_every_column(tables):
    rows = profiling.profile({k: tables[k] for k in ("wide", "none")}, "d").collect()
    assert {(r.table_name, r.column_name) for r in rows} == {k for k in brute(tables) if k[0] != "nested"}
    assert {r.column_name: r.examples for r in rows}["few"] == ["", "a", "b "]
