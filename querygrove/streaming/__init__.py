"""Result files as they arrive.

No operator keeps state over a stream; the text, prompt and reward columns work
on a streaming frame as they do on a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import MODEL_IN_NAME, RESULTS


def arriving_results(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Result files of a folder, one record per line, as a stream of records."""
    rows = (spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", files_per_trigger)
            .option("pathGlobFilter", "*.json").json(folder))
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), MODEL_IN_NAME, 1).alias("source_model"))
