"""Question sets, result files, filter lists and the tables written from them."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_arrays import read_array

QUESTIONS = "question string, db_id string, SQL string, evidence string"
RESULTS = ("question string, answers array<string>, generated_queries array<string>, labels array<int>, "
           "gold_query string, db_id string, evidence string")
FILTER_LIST = "question string, overall_confidence int"
CANDIDATES = ("question string, gold_query string, db_id string, evidence string, generated_query string, "
              "model_answer string, label int, source_model string")

# Where a result file's name holds the name of its model.
MODEL_IN_NAME = r"([^_/]+)_train_results\.json"


def read_questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of questions, read in as many tasks as its size asks for, or one question per line."""
    rows = spark.read.schema(QUESTIONS).json(path) if lines else read_array(spark, path, QUESTIONS).drop("file")
    return rows.withColumn("evidence", F.coalesce("evidence", F.lit("")))


def read_results(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Every ``*.json`` result of a folder, with its model and file.

    A file is a JSON array of records, or with ``lines`` one record per line.
    Both are read in as many tasks as their size asks for.  The job's own
    output belongs in another folder.
    """
    if lines:
        rows = spark.read.schema(RESULTS).option("recursiveFileLookup", "true").json(f"{folder}/*.json").select(
            "*", F.col("_metadata.file_path").alias("file"))
    else:
        rows = read_array(spark, f"{folder}/*.json", RESULTS, recursiveFileLookup="true")
    return rows.withColumn("source_model", F.regexp_extract("file", MODEL_IN_NAME, 1))


def read_filter_list(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
            .csv(path).select("question", F.col("overall_confidence").cast("int").alias("overall_confidence")))


def write_records(rows: DataFrame, path: str) -> None:
    """JSON records, one per line in each part.  Runs one job."""
    rows.write.mode("overwrite").json(path)


def write_arrays(rows: DataFrame, path: str) -> None:
    """One JSON array per part, a record on a line.  Runs one job."""
    def framed(batches):
        yield pa.RecordBatch.from_arrays([pa.array(["["])], names=["value"])
        first = True
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([t if first and not k else "," + t for k, t in enumerate(texts)],
                                                       pa.string())], names=["value"])
            first = first and not texts
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])
    rows.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def write_rows(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A Parquet table, replacing what an earlier run left.  Runs one job."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def run_manifest(spark: SparkSession, run_id: str, arguments: dict) -> DataFrame:
    """One row that says how a run was started; what JSON cannot hold is named in ``left_out``."""
    told, left_out = {}, []
    for name in sorted(arguments):
        try:
            told[name] = json.loads(json.dumps(arguments[name]))
        except (TypeError, ValueError):
            left_out.append(name)
    return spark.createDataFrame([(run_id, json.dumps(told), left_out)],
                                 "run_id string, arguments string, left_out array<string>")
