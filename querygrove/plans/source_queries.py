"""Files written from the tables and read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation
from ..session import fresh_path
from ..sources import descriptions, records
from . import fixtures as fx
from .curation_queries import result_lists
from .registry import query

MODELS = ("m0", "m1", "m2", "m3")
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


QUESTIONS = fx.with_views("candidates", """
SELECT 'Task ' || CAST(cand_id AS VARCHAR) || ': ' || question AS question, db_id, gold_query AS "SQL", evidence FROM candidates""")


def _questions(spark, sf_dir):
    rows = fx.view(spark, sf_dir, "candidates").select(
        F.concat(F.lit("Task "), F.col("cand_id").cast("string"), F.lit(": "), F.col("question")).alias("question"),
        "db_id", F.col("gold_query").alias("SQL"), F.when(F.col("evidence") != "", F.col("evidence")).alias("evidence"))
    return rows


@query("src_questions", QUESTIONS)
def questions(spark, sf_dir):
    path = fresh_path(spark, "questions")
    records.write_records(_questions(spark, sf_dir), path)
    return records.read_questions(spark, path, lines=True)


@query("src_questions_array", QUESTIONS)
def questions_array(spark, sf_dir):
    path = fresh_path(spark, "question-arrays")
    records.write_arrays(_questions(spark, sf_dir), path)
    return records.read_questions(spark, path)


@query("src_responses_json", fx.with_views("result_rows", """
SELECT task AS question, source_model, position, generated_query, model_answer, label, db_of_task AS db_id
FROM (SELECT *, min(db_id) OVER (PARTITION BY task, source_model) AS db_of_task FROM result_rows) t"""))
def responses_json(spark, sf_dir):
    rows = fx.view(spark, sf_dir, "result_rows")
    lists = result_lists(rows, ["task", "source_model"]).join(
        rows.groupBy("task", "source_model").agg(F.min("db_id").alias("db_id"), F.min("gold_query").alias("gold_query"),
                                                 F.min("evidence").alias("evidence")), ["task", "source_model"])
    folder = fresh_path(spark, "results")
    # One folder per model, named as its result file would be.
    for model in MODELS:
        records.write_records(
            lists.filter(F.col("source_model") == model).drop("source_model").withColumnRenamed("task", "question"),
            f"{folder}/2024-01-01_{model}_train_results.json")
    results = records.read_results(spark, folder, lines=True)
    flat = curation.explode_results(results, {"answers": "model_answer", "generated_queries": "generated_query",
                                              "labels": "label"})
    return flat.select("question", "source_model", "position", "generated_query", "model_answer", "label", "db_id")


@query("cat_descriptions", fx.with_views("lake_descriptions", """
SELECT 'lake' AS db_id, table_name, lower(db_id || '.' || column_name) AS column_name, trim(expanded_name) AS expanded_name,
 trim(replace(replace(column_description, chr(10), ' '), 'commonsense evidence:', '')) AS column_description,
 CASE WHEN value_description = '' THEN 'see the manual' ELSE value_description END AS value_description
FROM lake_descriptions"""))
def read_descriptions(spark, sf_dir):
    rows = fx.stored(spark, sf_dir, "lake_descriptions").select(
        "table_name", F.concat(F.lit(" "), F.col("db_id"), F.lit("."), F.col("column_name")).alias("original_column_name"),
        F.col("expanded_name").alias("column_name"),
        F.concat(F.lit("commonsense evidence: "), F.col("column_description")).alias("column_description"), "data_format",
        F.when(F.col("value_description") == "", F.lit("Not useful see the manual")).otherwise(F.col("value_description"))
        .alias("value_description"))
    root = fresh_path(spark, "descriptions")
    for kind in PART_TYPES:
        (rows.filter(F.col("table_name") == kind.lower()).drop("table_name").write.option("header", "true")
         .option("escape", '"').csv(f"{root}/lake/database_description/{kind}.csv"))
    read = descriptions.read_descriptions(spark, f"{root}/*/database_description/*.csv")
    return read.select("db_id", "table_name", "column_name", "expanded_name", "column_description", "value_description")
