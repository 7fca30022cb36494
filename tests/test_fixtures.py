"""Stored lake views: the rows of the plain views, made from one reading of the lines."""

from __future__ import annotations

import pytest

from querygrove.plans import fixtures as fx

LAKE = ["lake_stats", "lake_columns", "lake_keys", "lake_profile", "lake_descriptions", "lake_requests"]


@pytest.fixture
def lake_dir(spark, tmp_path):
    part = [(k, ["ECONOMY", "LARGE", "PROMO", "SMALL", None][k % 5], f"Brand#{k % 9}") for k in range(45)]
    spark.createDataFrame(part, "p_partkey long, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(k % 7 if k % 31 else None, k % 50, float(k % 6) if k % 8 else None, (k % 3) / 10, "R" if k % 2 else "N", "O") for k in range(600)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double, l_tax double, l_returnflag string, "
                          "l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("first", ["lake_stats", "lake_keys"])
def test_stored_views_are_the_views(spark, lake_dir, first):
    fx.stored(spark, lake_dir, first)
    for name in LAKE:
        plain, kept = fx.view(spark, lake_dir, name), fx.stored(spark, lake_dir, name)
        assert kept.schema.simpleString() == plain.schema.simpleString()
        assert kept.count() and sorted(map(repr, kept.collect())) == sorted(map(repr, plain.collect()))


def test_lines_are_read_once_for_the_columns(spark, lake_dir):
    fx.stored(spark, lake_dir, "lake_stats")
    for name in LAKE[1:]:
        files = fx._from_stored(spark, lake_dir, name).inputFiles()
        assert files and not any("lineitem" in f for f in files)
