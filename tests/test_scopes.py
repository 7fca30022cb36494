"""Words of nested texts: tasks follow the texts, whatever the session's shuffle partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from querygrove.operators import scopes


def test_tasks_follow_the_length_of_all_texts(spark, monkeypatch):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = spark.range(400).select(F.lit("d").alias("db_id"), F.format_string(
        "SELECT a FROM t WHERE b IN (SELECT c FROM u WHERE d = %d)", "id").alias("query"))
    columns = spark.createDataFrame([("d", t, c) for t, c in (("t", "a"), ("t", "b"), ("u", "c"), ("u", "d"))],
                                    "db_id string, table_name string, column_name string")
    monkeypatch.setattr(scopes, "CHARACTERS_PER_TASK", 500)
    words = scopes.placed_words(texts)
    assert words.select(F.spark_partition_id().alias("p")).distinct().count() > 3 * few
    used = scopes.columns_by_table(texts, columns).groupBy("table_name", "column_name").count().collect()
    assert {tuple(r) for r in used} == {("t", "a", 400), ("t", "b", 400), ("u", "c", 400), ("u", "d", 400)}


def test_no_texts_and_null_texts(spark):
    none = spark.createDataFrame([("d", None)], "db_id string, query string")
    assert scopes.placed_words(none).count() == 0
    assert scopes.placed_words(none.limit(0)).count() == 0
