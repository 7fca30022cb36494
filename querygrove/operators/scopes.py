"""Which query of a nested text each name belongs to.

A text becomes rows of words and marks with their places.  Brackets are paired
by their depth; those around a SELECT make a scope, and set operators cut a
scope into parts that do not see each other.  A part covers an interval of
places, so the parts around a name are those whose interval holds it, and the
innermost is the one that starts last.  No grammar is known beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sqltext
from ..functions.text import WORD
from .joins import salted_lookup

# Marks that are kept beside words, words that open a clause or
# join two queries, and the clauses in which a comma goes on to the next table.
MARKS = "[().,;<>=!+*/%|&-]"
CLAUSES = ["select", "from", "where", "group", "having", "order", "limit", "join", "on", "using", "window"]
SET_OPERATORS = ["union", "except", "intersect"]
TABLE_CLAUSES = ["from", "join", "on", "using"]
NEVER_A_NAME = sorted({*sqltext.NOT_AN_ALIAS, *CLAUSES, *SET_OPERATORS, "distinct", "all", "null", "true", "false"})
END = 2**31 - 1
# How many characters of texts one task takes apart: the sorted words of a task stay as few however many texts there are.
CHARACTERS_PER_TASK = 1_000_000


def query_id(db_id: Column, query: Column) -> Column:
    """A fixed-width stand-in for a query of a database."""
    return F.md5(F.to_json(F.struct(db_id.alias("d"), query.alias("q"))).cast("binary"))


def placed_words(queries: DataFrame) -> DataFrame:
    """``id, db_id, pos, word`` and what surrounds it, with the start and part of its scope.

    ``queries`` are distinct ``db_id, query``; a first pass sums up their
    lengths.  All windows share one exchange by text, with a task for each
    ``CHARACTERS_PER_TASK``, so a task's memory does not follow the input.
    """
    spark = queries.sparkSession
    length = queries.agg(F.sum(F.length("query").cast("long"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-length // CHARACTERS_PER_TASK))
    dealt = queries.select(query_id(F.col("db_id"), F.col("query")).alias("id"), "db_id", "query").repartition(tasks, "id")
    code = F.lower(sqltext.code_only(F.col("query")))
    rows = dealt.select("id", "db_id", F.posexplode(
        F.regexp_extract_all(code, F.lit(f"({WORD}|{MARKS})"), F.lit(1))).alias("pos", "word"))
    text = Window.partitionBy("id").orderBy("pos")
    opens_any, closes_any = F.col("word") == "(", F.col("word") == ")"
    word = F.col("word")
    rows = rows.select(
        "*", *[F.lag("word", k).over(text).alias(f"back{k}") for k in (1, 2, 3)],
        *[F.lead("word", k).over(text).alias(f"ahead{k}") for k in (1, 2)],
        F.sum(F.when(opens_any, 1).when(closes_any, -1).otherwise(0)).over(text).alias("depth"))
    rows = rows.withColumn("opens", opens_any & F.col("ahead1").isin("select", "with")).withColumn(
        "level", F.col("depth") + closes_any.cast("int"))
    same_level = Window.partitionBy("id", "level").orderBy("pos")
    rows = rows.withColumn("closes", closes_any & F.coalesce(
        F.last(F.when(opens_any, F.col("opens")), True).over(same_level), F.lit(False)))
    rows = rows.withColumn("nesting", F.sum(F.col("opens").cast("int") - F.col("closes").cast("int")).over(text)
                           + F.col("closes").cast("int"))
    inside = Window.partitionBy("id", "nesting").orderBy("pos")
    rows = rows.withColumn("scope", F.coalesce(F.last(F.when(F.col("opens"), F.col("pos")), True).over(inside), F.lit(-1)))
    rows = rows.withColumn("base", F.coalesce(F.last(F.when(F.col("opens"), F.col("depth")), True).over(inside), F.lit(0)))
    rows = rows.withColumn("direct", F.col("depth") == F.col("base"))
    own = Window.partitionBy("id", "scope").orderBy("pos")
    rows = rows.withColumn("part", F.sum((word.isin(SET_OPERATORS) & F.col("direct")).cast("int")).over(own))
    of_part = Window.partitionBy("id", "scope", "part").orderBy("pos")
    opener = word.isin(CLAUSES) & (F.col("direct") | word.isin("join", "on", "using"))
    rows = rows.withColumn("clause", F.last(F.when(opener, word), True).over(of_part))
    is_word = word.rlike(f"^{WORD}$") & ~word.isin(NEVER_A_NAME)
    starts = (((F.col("back1") == "from") & F.col("direct")) | (F.col("back1") == "join")
              | ((F.col("back1") == ",") & F.col("direct") & F.col("clause").isin(TABLE_CLAUSES))
              | ((F.col("back1") == "(") & F.col("back2").isin("from", "join", ",") & F.col("clause").isin(TABLE_CLAUSES)))
    in_schema = (F.col("back1") == ".") & (F.col("back3").isin("from", "join")
                                           | ((F.col("back3") == ",") & F.col("direct") & F.col("clause").isin(TABLE_CLAUSES)))
    names_table = is_word & F.coalesce(starts | in_schema, F.lit(False)) & ~F.coalesce(F.col("ahead1") == ".", F.lit(False))
    return rows.withColumn("is_table", names_table).withColumn(
        "is_alias", is_word & (F.coalesce(F.col("back1") == "as", F.lit(False))
                               | F.coalesce(F.lag("is_table").over(text), F.lit(False)))).withColumn("is_word", is_word)


def parts(words: DataFrame) -> DataFrame:
    """``id, scope, part, first, end``: the interval of places that each part of a scope covers."""
    each = words.groupBy("id", "scope", "part").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("closes").alias("closed"))
    after = F.lead("first").over(Window.partitionBy("id", "scope").orderBy("part"))
    closed = F.when((F.col("scope") >= 0) & F.col("closed"), F.col("last")).otherwise(F.lit(END))
    first = F.when(F.col("part") == 0, F.col("scope")).otherwise(F.col("first"))
    return each.select("id", "scope", "part", first.alias("first"), F.coalesce(after, closed).alias("end"))


def references(words: DataFrame) -> DataFrame:
    """``id, db_id, table, alias, at, first, end``: the tables named, each with the interval that sees it."""
    follows = F.when(F.col("ahead1") == "as", F.col("ahead2")).when(
        F.col("ahead1").rlike(f"^{WORD}$") & ~F.col("ahead1").isin(NEVER_A_NAME), F.col("ahead1"))
    named = words.filter("is_table").select("id", "db_id", F.col("word").alias("table"), F.coalesce(
        follows, F.col("word")).alias("alias"), F.col("pos").alias("at"), "scope", "part")
    return named.join(parts(words), ["id", "scope", "part"]).drop("scope", "part")


def mentions(words: DataFrame) -> DataFrame:
    """``id, db_id, pos, qualifier, column``: words that may be columns, '' without a qualifier."""
    plain = F.col("is_word") & ~F.col("is_table") & ~F.col("is_alias") & ~F.coalesce(
        F.col("ahead1").isin("(", "."), F.lit(False))
    qualifier = F.when(F.col("back1") == ".", F.col("back2")).otherwise(F.lit(""))
    return words.filter(plain).select("id", "db_id", "pos", qualifier.alias("qualifier"), F.col("word").alias("column"))


def tables_used(queries: DataFrame, columns: DataFrame) -> DataFrame:
    """``db_id, query, table_name``: the catalog's tables that stand where a query names its tables."""
    named = references(placed_words(queries)).select("id", "db_id", F.col("table").alias("_t")).distinct()
    tables = columns.select("db_id", F.lower("table_name").alias("_t"), "table_name").distinct()
    return _with_texts(queries, salted_lookup(named, tables, ["db_id", "_t"], "inner").select("id", "table_name"))


def columns_by_table(queries: DataFrame, columns: DataFrame) -> DataFrame:
    """``db_id, query, table_name, column_name``: the columns that each query uses, of all its scopes.

    A qualifier means the innermost table or alias of that name around it; a
    name without one the first table, from the innermost scope outwards, that
    has such a column.  Qualifiers that name no table of the catalog, such as
    those of derived tables, give nothing: their columns count where the
    derived table takes them from.
    """
    words = placed_words(queries)
    refs = references(words).drop("db_id")
    known = columns.select("db_id", F.lower("table_name").alias("table"), F.lower("column_name").alias("column"),
                           "table_name", "column_name")
    bare = F.col("qualifier") == ""
    seen = mentions(words).join(refs, "id").filter(
        (F.col("first") <= F.col("pos")) & (F.col("pos") < F.col("end"))
        & (bare | (F.col("alias") == F.col("qualifier")) | (F.col("table") == F.col("qualifier"))))
    found = salted_lookup(seen, known, ["db_id", "table", "column"], "left")
    missing = F.col("column_name").isNull()
    nearest = F.struct((bare & missing).alias("m"), (-F.col("first")).alias("f"), "at", "table_name")
    best = found.groupBy("id", "pos").agg(F.min_by(F.struct("table_name", "column_name"), nearest).alias("_best"))
    used = best.filter("_best.column_name IS NOT NULL").select("id", "_best.table_name", "_best.column_name").distinct()
    return _with_texts(queries, used)


def _with_texts(queries: DataFrame, found: DataFrame) -> DataFrame:
    texts = queries.select(query_id(F.col("db_id"), F.col("query")).alias("id"), "db_id", "query")
    rest = [c for c in found.columns if c != "id"]
    return texts.join(found, "id").select("db_id", "query", *rest)
