"""How close a candidate query is to the gold query, by words and names.

Names are the words of a query that the catalog of its database knows.
:mod:`.scopes` tells which table of a nested query a column belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext
from .joins import salted_lookup
from .scopes import columns_by_table, tables_used  # noqa: F401

# Points for a right result, a query that runs, right names and
# right word pairs.
POINTS = {"label": 4, "syntax_check": 2, "schema_linking": 2, "ngram_jaccard": 2}

def ngram_jaccard(rows: DataFrame, left: str = "generated_query", right: str = "gold_query",
                  n: int = 2, name: str = "ngram_jaccard") -> DataFrame:
    """Adds the share of word n-grams that both queries have."""
    grams = (rows.withColumn("_left", sqltext.ngrams(F.col(left), n))
             .withColumn("_right", sqltext.ngrams(F.col(right), n)))
    return grams.withColumn(name, sqltext.jaccard(F.col("_left"), F.col("_right"))).drop("_left", "_right")


def catalog_names(columns: DataFrame) -> DataFrame:
    """Lower-cased table and column names of each database, as one list.

    A list is as long as the schema of one database is wide.
    """
    names = F.explode(F.array(F.lower("table_name"), F.lower("column_name")))
    return columns.select("db_id", names.alias("_name")).groupBy("db_id").agg(
        F.collect_set("_name").alias("_names"))


def schema_recall(rows: DataFrame, columns: DataFrame, parsed: Column | None = None,
                  name: str = "schema_linking") -> DataFrame:
    """Adds the share of the gold query's names that the candidate has too.

    Null when the gold query names nothing; 0 where ``parsed`` is false.
    """
    def known(query: str) -> Column:
        return F.filter(sqltext.code_words(F.col(query)), lambda w: F.array_contains("_names", F.lower(w)))

    found = (salted_lookup(rows, catalog_names(columns), ["db_id"], "left")
             .withColumn("_gold", known("gold_query")).withColumn("_found", known("generated_query")))
    share = F.size(F.array_intersect("_gold", "_found")) / F.size("_gold")
    score = F.when(F.size("_gold") > 0, share)
    if parsed is not None:
        score = F.when(~parsed, F.lit(0.0)).otherwise(score)
    return found.withColumn(name, score).drop("_names", "_gold", "_found").select(*rows.columns, name)


def composite(label: Column, syntax_check: Column, schema_linking: Column, ngram_jaccard: Column,
              graded: bool = False) -> Column:
    """Points out of 10.  Partial scores count as nothing unless ``graded``."""
    scores = dict(label=label, syntax_check=syntax_check, schema_linking=schema_linking,
                  ngram_jaccard=ngram_jaccard)
    total = F.lit(0.0)
    for part, points in POINTS.items():
        value = scores[part].cast("double")
        total = total + (value if graded else F.floor(value)) * F.lit(float(points))
    return total if graded else total.cast("int")


def distinct_queries(rows: DataFrame, query: str = "generated_query") -> DataFrame:
    """Each query of each database once, as ``db_id, query``."""
    return rows.select("db_id", F.col(query).alias("query")).filter(F.col("query").isNotNull()).distinct()


def union_schema(used: DataFrame, by: list[str]) -> DataFrame:
    """Columns used by any query of a group, each once."""
    return used.select(*by, "table_name", "column_name").distinct()
