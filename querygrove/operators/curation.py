"""From recorded model answers to a table of distinct candidate queries.

Input rows are flat, one per answer.  Their order is given by explicit columns
(file, position), never by the order rows happen to arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext
from ..functions.text import collapse_blanks, strip
from .joins import hot_salted_lookup, salted_lookup


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``.

    An aggregate, not a window: every map task keeps one row per key before the
    shuffle, so a key repeated in a third of the rows costs one row per task.
    """
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return (rows.groupBy(*keys).agg(first)
            .select(*[c if c in keys else F.col(f"_first.`{c}`").alias(c) for c in rows.columns]))


def explode_results(results: DataFrame, lists: dict[str, str]) -> DataFrame:
    """Parallel lists to rows; the shortest list sets the number of rows.

    ``lists`` maps a list column to the name of its row column.  The position
    in the list is kept as ``position``.
    """
    shortest = F.least(*[F.size(c) for c in lists]) if len(lists) > 1 else F.size(*lists)
    zipped = F.slice(F.arrays_zip(*lists), F.lit(1), F.greatest(shortest, F.lit(0)))
    kept = [c for c in results.columns if c not in lists]
    rows = results.select(*kept, F.posexplode(zipped).alias("position", "_row"))
    return rows.select(*kept, "position",
                       *[F.col(f"_row.`{c}`").alias(name) for c, name in lists.items()])


def drop_listed(rows: DataFrame, filter_list: DataFrame, confidence: int = 10) -> DataFrame:
    """Remove the questions that the filter list holds with full confidence."""
    listed = (filter_list.filter(F.col("overall_confidence") == confidence)
              .select("question").distinct())
    return salted_lookup(rows, listed, ["question"], "left_anti")


def consolidate(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of all files under one question, gold and evidence from the first.

    The result stays flat: one row per answer, with the question's gold query
    and evidence, in place of lists that grow with the number of files.
    """
    shared = ["gold_query", "evidence"]
    head = first_per_key(rows.select(*keys, *order, *shared), keys, order).select(*keys, *shared)
    return hot_salted_lookup(rows.drop(*shared), head, keys, "inner").select(*rows.columns)


def question_summary(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per question: gold and evidence of the first row, and counts."""
    return rows.groupBy(*keys).agg(
        F.min_by("gold_query", F.struct(*order)).alias("gold_query"),
        F.min_by("evidence", F.struct(*order)).alias("evidence"),
        F.count(F.lit(1)).alias("n_answers"),
        F.sum("label").cast("bigint").alias("n_correct"),
        F.countDistinct("source_model").alias("n_models"),
    )


def dedup_answers(rows: DataFrame, keys: list[str], order: list[str],
                  query: str = "generated_query", answer: str = "model_answer") -> DataFrame:
    """First answer per query text with blanks collapsed; case is kept."""
    texts = (rows.withColumn(query, collapse_blanks(F.col(query)))
             .withColumn(answer, strip(F.col(answer))))
    return first_per_key(texts, [*keys, query], order)


def dedup_candidates(rows: DataFrame, keys: list[str], order: list[str],
                     query: str = "generated_query", trim_tail: bool = False) -> DataFrame:
    """First candidate per normalised query; adds ``norm_sql``, keeps the original."""
    normal = rows.withColumn("norm_sql", sqltext.normalize_sql(F.col(query), trim_tail))
    return first_per_key(normal, [*keys, "norm_sql"], order)


def string_clusters(rows: DataFrame, keys: list[str], order: list[str],
                    query: str = "generated_query") -> DataFrame:
    """One row per cleaned query text: its first query and its size."""
    return (rows.withColumn("clean_sql", sqltext.clean_sql(F.col(query)))
            .groupBy(*keys, "clean_sql")
            .agg(F.min_by(query, F.struct(*order)).alias("first_query"),
                 F.count(F.lit(1)).alias("n_queries")))


def count_by(rows: DataFrame, *columns: str | Column) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))
