"""Recorded model answers to labelled candidates, one row per distinct query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import extract_sql
from ..operators import curation, execution
from ..operators.scoring import distinct_queries
from ..session import write_and_read


def labelled_answers(spark: SparkSession, answers: DataFrame, tables: execution.Tables,
                     keys: tuple[str, ...] = ("source_model", "db_id", "question"),
                     order: tuple[str, ...] = ("position",)) -> DataFrame:
    """Extract the SQL of each ``model_answer``, drop repeats, run and label.

    ``answers`` holds ``gold_query`` and the key and order columns.  Each text
    runs once however many answers have it.  Jobs run while this is called.
    """
    texts = answers.withColumn("generated_query", extract_sql(F.col("model_answer"), strip_plain=False))
    distinct = write_and_read(curation.dedup_answers(texts, list(keys), list(order)), "answers")
    queries = distinct_queries(distinct).unionByName(distinct_queries(distinct, "gold_query")).distinct()
    results = execution.run_queries(spark, queries, tables)
    return execution.labelled(distinct, results).withColumn("label", F.col("exec_res"))
