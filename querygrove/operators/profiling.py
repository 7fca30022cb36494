"""Counts, distinct values, lengths and examples of every column at once.

All columns of a table become one long frame, so a profile takes two shuffles
whatever the number of columns, and a frequent value is counted in the map
tasks before it moves.  Counts need no values: a column is a number there and a
cell 128 bits.  Whether a column has few values is asked of a sketch of fixed
size, which moves one row for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import union_all

COLUMN = ["db_id", "table_name", "column_name"]

# The limits of the categorical test and of the examples.
CATEGORICAL_BELOW = 20
CATEGORICAL_EXAMPLES = 5
OTHER_EXAMPLES = 3
EXAMPLE_WIDTH = 50

# The sketch of the categorical test holds 2 ** SKETCHED_LOG digests, more than the test asks for.
SKETCHED_LOG = 5


def _as_text(df: DataFrame, field: T.StructField) -> Column:
    column = df[f"`{field.name}`"]
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        column = column + F.lit(0.0)  # -0.0 and 0.0 are one value
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(column.isNotNull(), F.to_json(F.struct(column.alias("v"))))
    return column.cast("string")


def long_values(df: DataFrame, db_id: str, table_name: str, text_only: bool = False) -> DataFrame:
    """``db_id, table_name, column_name, value``: one row per cell, nulls kept."""
    fields = [f for f in df.schema.fields if not text_only or isinstance(f.dataType, T.StringType)]
    texts = df.select(*[_as_text(df, f).alias(f.name) for f in fields])
    return texts.unpivot([], [F.col(f"`{f.name}`") for f in fields], "column_name", "value").select(
        F.lit(db_id).alias("db_id"), F.lit(table_name).alias("table_name"), "column_name", "value")


def list_columns(tables: dict[str, DataFrame], db_id: str) -> DataFrame:
    """The catalog table of registered sources, from their schemas alone."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(db_id, t, f.name, i, f.dataType.simpleString())
            for t, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(
        rows, "db_id string, table_name string, column_name string, ordinal int, data_type string")


def value_counts(values: DataFrame) -> DataFrame:
    """How often each value, null included, occurs in each column."""
    return values.groupBy(*COLUMN, "value").agg(F.count(F.lit(1)).alias("n"))


def digest_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``column, x1, x2, n``: how often each cell occurs, by its digest; columns are numbered as :func:`list_columns`
    lists them, nulls have no digest."""
    frames, at = [], 0
    for df in tables.values():
        cells = []
        for field in df.schema.fields:
            text = _as_text(df, field)
            cells.append(F.struct(F.lit(at).alias("column"), F.when(text.isNotNull(), F.xxhash64(text)).alias("x1"),
                                  F.when(text.isNotNull(), F.xxhash64(F.lit(7), text)).alias("x2")))
            at += 1
        frames.append(df.select(F.inline(F.array(*cells))))
    return union_all(frames).groupBy("column", "x1", "x2").agg(F.count(F.lit(1)).alias("n"))


def counts_of_tables(tables: dict[str, DataFrame], db_id: str) -> DataFrame:
    """Non-null, distinct and null counts of every column, zeros for those of an empty table.

    No cell reaches a shuffle, only its digest.
    """
    filled = F.col("x1").isNotNull()
    counts = digest_counts(tables).groupBy("column").agg(
        F.sum(F.when(filled, F.col("n"))).alias("n_nonnull"), F.count("x1").alias("n_distinct"),
        F.sum(F.when(~filled, F.col("n"))).alias("n_null"))
    return _named(tables, db_id).join(counts, "column", "left").drop("column").na.fill(0)


def _named(tables: dict[str, DataFrame], db_id: str) -> DataFrame:
    """COLUMN and the number of each column, from the schemas alone."""
    spark = next(iter(tables.values())).sparkSession
    names = [(t, f.name) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame([(i, db_id, t, c) for i, (t, c) in enumerate(names)],
                                 "column int, db_id string, table_name string, column_name string")


def few_values(tables: dict[str, DataFrame], db_id: str) -> DataFrame:
    """COLUMN and ``is_categorical``, exact, without counting the values.

    The sketch keeps the least SKETCHED digests of a column: below that many
    distinct values it holds all of them, and above it never estimates less.
    """
    rows, at = [], 0
    for df in tables.values():
        cells = []
        for field in df.schema.fields:
            text = _as_text(df, field)
            few = F.coalesce(F.theta_sketch_estimate(F.theta_sketch_agg(
                F.when(text.isNotNull(), F.xxhash64(text)), SKETCHED_LOG)), F.lit(0))
            cells.append(F.struct(F.lit(at).alias("column"), few.alias("n_distinct"), F.count_if(text.isNull()).alias("n_null")))
            at += 1
        rows.append(df.agg(F.array(*cells).alias("cells")).select(F.inline("cells")))
    found = union_all(rows).select("column", is_categorical().alias("is_categorical"))
    return _named(tables, db_id).join(found, "column").drop("column")


def column_counts(counted: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Non-null, distinct and null counts from :func:`value_counts`.

    With ``columns`` the columns of an empty table are listed with zeros.
    """
    filled = F.col("value").isNotNull()
    counts = counted.groupBy(*COLUMN).agg(
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("n_nonnull"),
        F.count("value").alias("n_distinct"),
        F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("n_null"))
    if columns is None:
        return counts
    return columns.select(*COLUMN).join(counts, COLUMN, "left").na.fill(0)


def is_categorical() -> Column:
    """Few distinct values, where null counts as one more."""
    return F.col("n_distinct") + F.when(F.col("n_null") > 0, 1).otherwise(0) < CATEGORICAL_BELOW


def distinct_values(counted: DataFrame) -> DataFrame:
    return counted.filter(F.col("value").isNotNull()).select(*COLUMN, "value")


def text_lengths(distinct: DataFrame) -> DataFrame:
    """Summed length and number of the distinct values of each column."""
    return distinct.groupBy(*COLUMN).agg(
        F.sum(F.length("value").cast("bigint")).alias("sum_of_lengths"),
        F.count(F.lit(1)).alias("count_distinct"))


def examples(counted: DataFrame, counts: DataFrame, columns: DataFrame) -> DataFrame:
    """A few values of each column, the first by value.

    Five of a categorical column, else three if the first is short.  A date
    column, by type or name, takes the second form if it can.  Spark keeps the
    first values of a column in each map task, so a long column stays spread.
    """
    # Ranking nulls last and by count too leaves the input as column_counts()
    # reads it, so the values are shuffled once for both.
    first = Window.partitionBy(*COLUMN).orderBy(F.col("value").asc_nulls_last(), "n")
    top = (counted.withColumn("_rank", F.row_number().over(first))
           .filter((F.col("_rank") <= CATEGORICAL_EXAMPLES) & F.col("value").isNotNull())
           .groupBy(*COLUMN).agg(F.array_sort(F.collect_list("value")).alias("_top")))
    text = F.lower("data_type").isin("string", "text") | F.contains(F.lower("data_type"), F.lit("char"))
    # The width is that of the value printed as a one-element tuple.
    width = F.length(F.try_element_at("_top", F.lit(1))) + F.when(text, 5).otherwise(3)
    few = F.when((F.size("_top") > 0) & (width < EXAMPLE_WIDTH), F.slice("_top", 1, OTHER_EXAMPLES))
    dated = (F.lower("data_type") == "date") | F.contains(F.lower("column_name"), F.lit("date"))
    listed = F.when(is_categorical() & (F.size("_top") > 0), F.col("_top"))
    chosen = F.when(dated, F.coalesce(few, listed)).otherwise(F.coalesce(listed, few))
    none = F.array().cast("array<string>")
    return (columns.select(*COLUMN, "data_type").join(counts, COLUMN).join(top, COLUMN, "left")
            .select(*COLUMN, F.coalesce(chosen, none).alias("examples")))


def profile(tables: dict[str, DataFrame], db_id: str) -> DataFrame:
    """The profile table of a database: counts, categorical test, examples."""
    columns = list_columns(tables, db_id)
    counted = value_counts(union_all([long_values(df, db_id, t) for t, df in tables.items()]))
    counts = counts_of_tables(tables, db_id)
    return (counts.withColumn("is_categorical", is_categorical())
            .join(examples(counted, counts, columns), COLUMN))
