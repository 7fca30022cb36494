"""Column descriptions, one CSV file per table under each database's folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

DESCRIPTIONS = ("original_column_name string, column_name string, column_description string, "
                "data_format string, value_description string")
PLACE = r"([^/]+)/database_description/([^/]+?)\.csv"

# The characters that Windows code page 1252 has in place of the
# control characters 0x80 to 0x9f; five places are unused.
CODE_PAGE_1252 = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰",
    0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•",
    0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}
# Words dropped from the texts.
DROPPED_WORDS = "commonsense evidence:"
USELESS = "not useful"


def _read(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    rows = (spark.read.schema(DESCRIPTIONS).option("header", "true").option("multiLine", "true")
            .option("escape", '"').option("encoding", encoding).csv(path))
    return rows.select("*", F.col("_metadata.file_path").alias("_file"))


def _plain(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit("")))


def _described(name: str) -> Column:
    text = F.replace(F.coalesce(F.col(name), F.lit("")), F.lit("\n"), F.lit(" "))
    return strip(F.replace(text, F.lit(DROPPED_WORDS), F.lit("")))


def read_descriptions(spark: SparkSession, path: str, with_values: bool = True) -> DataFrame:
    """``db_id, table_name, column_name`` in lower case and the cleaned texts.

    ``path`` matches the files, as in ``root/*/database_description/*.csv``.
    A file that is not valid UTF-8 is read again as Windows text; both readings
    are plain scans and the choice is a join on the file name.
    """
    utf8 = _read(spark, path, "UTF-8")
    texts = [F.coalesce(F.contains(c, F.lit("�")), F.lit(False))
             for c in utf8.columns if c != "_file"]
    broken = texts[0]
    for test in texts[1:]:
        broken = broken | test
    bad_files = utf8.filter(broken).select("_file").distinct()
    windows = _read(spark, path, "ISO-8859-1")
    for c in windows.columns:
        if c != "_file":
            windows = windows.withColumn(c, F.translate(
                c, "".join(map(chr, CODE_PAGE_1252)), "".join(CODE_PAGE_1252.values())))
    rows = (utf8.join(bad_files, "_file", "left_anti")
            .unionByName(windows.join(bad_files, "_file", "left_semi")))
    values = _described("value_description") if with_values else F.lit("")
    useless = F.startswith(F.lower(values), F.lit(USELESS))
    return rows.filter(F.col("original_column_name").isNotNull()).select(
        F.regexp_extract("_file", PLACE, 1).alias("db_id"),
        F.lower(strip(F.regexp_extract("_file", PLACE, 2))).alias("table_name"),
        F.lower(strip(F.col("original_column_name"))).alias("column_name"),
        F.col("original_column_name"),
        _plain("column_name").alias("expanded_name"),
        _described("column_description").alias("column_description"),
        _plain("data_format").alias("data_format"),
        F.when(useless, strip(F.substring(values, F.lit(len(USELESS) + 1), F.length(values)))).otherwise(values)
        .alias("value_description"))
