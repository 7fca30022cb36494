"""Running recorded SQL on Spark and labelling it by its result.

Recorded texts differ mostly in what they compare with.  A literal behind a
comparison is lifted out of its text into a table; what is left is the shape.
A shape becomes one plan on the driver, joined laterally with the literals of
all its texts, so driver work follows the number of shapes.  The driver walks
over the shapes a batch at a time.  Scans, shuffles and hashes run on the
executors; what comes back is one row per text, written to the shared folder.
Texts are untrusted and pass a guard.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sqltext import COMMENT_OUTSIDE_QUOTES
from ..functions.text import let
from ..session import fresh_path
from .joins import union_all

# Reads the tables of a database in the session given.
Tables = Callable[[SparkSession, str], dict[str, DataFrame]]

BATCH = 64
WORKERS = 4
# The size of a preview, and status texts.
SHOWN_ROWS = 20
PREVIEW_CHARS = 2000
# One row in so many is ranked for the bound that all rows of a preview are then compared with.
RANKED_FOR_BOUND = 64
RIGHT, WRONG, TIMEOUT = "--", "incorrect answer", "timeout"

# Function names that reach outside SQL.
REFUSED = re.compile(r"\b(reflect|try_reflect|java_method|identifier|read_files)\s*`?\s*\(", re.IGNORECASE)
REFUSED_IN_PLAN = re.compile(r"\b(reflect|try_reflect|java_method|callmethodviareflection)\b", re.IGNORECASE)
QUERY_START = re.compile(r"[\s(]*(select|with|values)\b", re.IGNORECASE)
QUOTED_TEXT = re.compile(r"'[^']*'|\"[^\"]*\"")
ORDERED = re.compile(r"\border\s+by\b", re.IGNORECASE)
# Characters that JSON escapes, as SQL text of a Java pattern.
ESCAPED = r"""[\\x00-\\x1f"\\\\]"""
RELATION = re.compile(r"UnresolvedRelation \[([^\]]*)\]")
COMMON_TABLES = re.compile(r"\bCTE \[([^\]]*)\]")

# A text as pieces without gaps: quoted parts, comments, comparisons, words, and single characters.
PIECES = r"""(?s)('(?:[^']|'')*'|"[^"]*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[=<>!]+\s*|[\p{L}\p{N}_.]+|.)"""
COMPARISON = r"^(=|==|<|>|<=|>=|<>|!=)\s*$"
LITERAL = r"^('[^'\\]*'|[0-9]{1,9})$"
HOLE = "\x01"

RESULT = ("db_id string, query string, n_columns int, n_distinct bigint, x1 bigint, x2 bigint, "
          "preview string, error string")
FIELDS = ["n_columns", "n_distinct", "x1", "x2", "preview", "error"]


class Refused(ValueError):
    """The text is not a plain query."""


def _code(query: str) -> str:
    return QUOTED_TEXT.sub("''", re.sub(COMMENT_OUTSIDE_QUOTES, r"\1", query))


def wrapped(query: str) -> str:
    """The text as a sub-query: anything but one query fails to parse."""
    code = _code(query)
    if not QUERY_START.match(code):
        raise Refused("not a query")
    if REFUSED.search(code):
        raise Refused("function not allowed")
    return f"SELECT * FROM (\n{query.rstrip().rstrip(';').rstrip()}\n) q"


def candidate_session(spark: SparkSession, db_id: str, tables: Tables) -> SparkSession:
    """A session that sees the tables of one database and no files.

    Division by zero gives null in it, as in the dialect the texts were written for.
    """
    session = spark.newSession()
    found = tables(session, db_id)
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    session.candidate_tables = {name.lower() for name in found}
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    session.conf.set("spark.sql.ansi.enabled", "false")
    return session


def _refuse_other_tables(session: SparkSession, text: str) -> None:
    """Raises where a text names anything but the tables of its database and its own common tables."""
    plan = session._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
    own = {n.strip().lower() for names in COMMON_TABLES.findall(plan) for n in names.split(",")}
    for name in RELATION.findall(plan):
        if name.strip().lower() not in session.candidate_tables | own:
            raise Refused(f"unknown table {name}")


def planned(session: SparkSession, query: str) -> DataFrame:
    """The analysed query.  No job runs; a bad text raises."""
    text = wrapped(query)
    _refuse_other_tables(session, text)
    df = session.sql(text)
    in_text = any(REFUSED_IN_PLAN.search(t) for t in QUOTED_TEXT.findall(query))
    if not in_text and REFUSED_IN_PLAN.search(df._jdf.queryExecution().analyzed().toString()):
        raise Refused("function not allowed")
    return df


def message(error: Exception) -> str:
    """The first line of an error, without the plan behind it."""
    return str(error).strip().split("\n")[0]


def cell(name: str, kind: T.DataType) -> str:
    """SQL for a value as comparable text: 1 equals 1.0 and differs from '1'."""
    if isinstance(kind, T.BooleanType):
        text = f"concat('n', CAST(CAST({name} AS INT) AS STRING))"
    elif isinstance(kind, T.IntegralType):
        text = f"concat('n', CAST({name} AS STRING))"
    elif isinstance(kind, T.NumericType):
        number = f"CAST({name} AS DOUBLE)"
        text = (f"concat('n', CASE WHEN {number} = floor({number}) AND abs({number}) < 1e18D "
                f"THEN CAST(CAST({number} AS BIGINT) AS STRING) ELSE CAST({number} + 0.0D AS STRING) END)")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = f"concat('j', to_json(named_struct('v', {name})))"
    elif isinstance(kind, T.BinaryType):
        text = f"concat('b', hex({name}))"
    else:
        text = f"concat('s', CAST({name} AS STRING))"
    return f"coalesce({text}, '0')"


def _names(df: DataFrame) -> list[str]:
    return [f"c{i}" for i in range(len(df.columns))]


def _cells(df: DataFrame) -> list[str]:
    return [cell(n, f.dataType) for n, f in zip(_names(df), df.schema.fields)]


def _hashes(df: DataFrame) -> list[str]:
    """SQL for two 64-bit hashes of a row, over the values and not the names."""
    cells = _cells(df)
    return [f"xxhash64({', '.join(cells)}) AS a", f"xxhash64(7, {', '.join(reversed(cells))}) AS b"]


def row_hashes(df: DataFrame) -> DataFrame:
    return df.toDF(*_names(df)).selectExpr(*_hashes(df))


def _set_of_rows() -> list[Column]:
    return [F.count("a").alias("n_distinct"), F.coalesce(F.bit_xor("a"), F.lit(0)).alias("x1"),
            F.coalesce(F.bit_xor("b"), F.lit(0)).alias("x2")]


def fingerprint(df: DataFrame) -> DataFrame:
    """One row for the set of rows: its size and two order-free hashes.

    The hashes stand for a row in the shuffle, so wide rows do not move and
    repeated rows are dropped in the map tasks.
    """
    return row_hashes(df).distinct().agg(F.lit(len(df.columns)).alias("n_columns"), *_set_of_rows())


def _printed(df: DataFrame, chars: int) -> str:
    """SQL for a row as a JSON list: numbers bare, other values quoted."""
    cells = []
    for name, field in zip(_names(df), df.schema.fields):
        text = f"CAST({name} AS STRING)"
        if not isinstance(field.dataType, T.NumericType):
            # Most values need no escapes.  In a list of one the value is quoted, so its own brackets are not trimmed.
            text = (f"CASE WHEN is_valid_utf8({text}) AND NOT {text} RLIKE '{ESCAPED}' THEN concat('\"', {text}, '\"') "
                    f"ELSE trim(BOTH '[]' FROM to_json(array({text}))) END")
        cells.append(f"CASE WHEN {name} IS NULL THEN 'null' ELSE {text} END")
    between = ", ', ', ".join(cells)
    return f"substring(concat('[', {between}, ']'), 1, {chars}) AS row"


def _preview_text(n_rows: Column, n_columns: Column, shown: Column, chars: int) -> Column:
    """The number of rows, of columns, and the first rows."""
    columns = F.when(n_rows > 0, n_columns).otherwise(F.lit(0))
    text = F.concat(F.lit("Rows: "), n_rows.cast("string"), F.lit(", Columns: "), columns.cast("string"),
                    F.lit(", Results: ["), F.array_join(shown, ", "), F.lit("]"))
    return F.substring(text, 1, chars)


def preview(df: DataFrame, rows: int = SHOWN_ROWS, chars: int = PREVIEW_CHARS) -> DataFrame:
    """The preview of one result: all its rows counted in the map tasks, the first ``rows`` shown."""
    named = df.toDF(*_names(df))
    counted = named.agg(F.count(F.lit(1)).alias("n"))
    shown = named.limit(rows).selectExpr(_printed(df, chars)).agg(F.collect_list("row").alias("shown"))
    return shown.select(_preview_text(counted.scalar(), F.lit(len(df.columns)), F.col("shown"), chars).alias("preview"))


def set_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row ``exec_res``: 1 if both have the same, non-empty set of rows."""
    both = fingerprint(left).unionAll(fingerprint(right))
    same = F.countDistinct("n_columns", "n_distinct", "x1", "x2") == 1
    return both.agg((same & (F.min("n_distinct") > 0)).cast("int").alias("exec_res"))


def set_equal_by_except(left: DataFrame, right: DataFrame) -> DataFrame:
    """The same answer from the rows themselves, by EXCEPT in both directions."""
    if len(left.columns) != len(right.columns):
        return left.sparkSession.range(1).select(F.lit(0).alias("exec_res"))

    def cells(df: DataFrame) -> DataFrame:
        return df.toDF(*_names(df)).selectExpr(*[f"{c} AS {n}" for n, c in zip(_names(df), _cells(df))])

    a, b = cells(left), cells(right)
    parts = [a.subtract(b).limit(1).select(F.lit("differs").alias("k")),
             b.subtract(a).limit(1).select(F.lit("differs").alias("k")), a.limit(1).select(F.lit("left").alias("k"))]
    found = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return found.agg(((F.count_if(F.col("k") == "differs") == 0) & (F.count_if(F.col("k") == "left") > 0))
                     .cast("int").alias("exec_res"))


def text_id(query: str) -> Column:
    """A fixed-width stand-in for a text of a database."""
    return F.md5(F.to_json(F.struct("db_id", F.col(query).alias("query"))).cast("binary"))


def with_shapes(queries: DataFrame, whole_if_ordered: bool = False) -> DataFrame:
    """Distinct ``db_id, query`` with ``text_id``, the ``shape`` and the ``literals`` lifted out of it.

    Lifted are short whole numbers and plain strings right behind a comparison;
    any other literal may mean more than its value and stays.  With
    ``whole_if_ordered`` texts that order their rows stay whole, as an order
    does not outlive a join.
    """
    def lifted(pieces: Column, piece: Column, i: Column) -> Column:
        return piece.rlike(LITERAL) & F.coalesce(F.get(pieces, i - 1).rlike(COMPARISON), F.lit(False))

    def split(pieces: Column) -> Column:
        hole = F.lit(HOLE)
        kind = lambda x: F.when(F.startswith(x, F.lit("'")), F.lit("s")).otherwise(F.lit("i"))
        shape = F.transform(pieces, lambda x, i: F.when(
            lifted(pieces, x, i), F.concat(hole, kind(x), F.lit(HOLE))).otherwise(x))
        return F.struct(F.array_join(shape, "").alias("shape"), F.filter(
            pieces, lambda x, i: lifted(pieces, x, i)).alias("literals"))

    rows = queries.select("db_id", "query").filter(F.col("query").isNotNull()).distinct()
    parts = let(F.regexp_extract_all("query", F.lit(PIECES), F.lit(1)), split)
    whole = F.contains("query", F.lit(HOLE)) | (F.size(parts["literals"]) == 0)
    if whole_if_ordered:
        whole = whole | F.col("query").rlike("(?i)\\border\\s+by\\b")
    named = rows.withColumn("_p", parts).withColumn("_whole", whole)
    return named.select(
        "db_id", "query", text_id("query").alias("text_id"),
        F.when(F.col("_whole"), F.col("query")).otherwise(F.col("_p.shape")).alias("shape"),
        F.when(F.col("_whole"), F.array().cast("array<string>")).otherwise(F.transform("_p.literals", lambda x: F.regexp_replace(
            x, "^'|'$", ""))).alias("literals")).withColumn(
        "shape_id", F.md5(F.to_json(F.struct("db_id", "shape")).cast("binary")))


def _batches(shapes: DataFrame, size: int) -> Iterator[list]:
    """Shapes in batches of one database, in the order that their texts are stored in.

    Only one partition at a time reaches the driver.
    """
    batch: list = []
    for row in shapes.orderBy("db_id", "shape_id").toLocalIterator():
        if batch and (len(batch) >= size or batch[0].db_id != row.db_id):
            yield batch
            batch = []
        batch.append(row)
    if batch:
        yield batch


def _plan_all(session: SparkSession, queries: list[str]) -> list[DataFrame | Exception]:
    def plan(query):
        try:
            return planned(session, query)
        except Exception as error:  # whatever a text raises is its result
            return error
    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(plan, queries))


def _rows_of(shape, df: DataFrame, texts: DataFrame, session: SparkSession, more: tuple[str, ...] = ()) -> DataFrame:
    """``text_id`` and the values of the rows of all texts of a shape, named by :func:`_names`.

    The literals of the texts are a table; the shape is a lateral sub-query
    that reads its own from there.  ``more`` names columns of the texts, for
    shapes with literals.
    """
    columns = ", ".join(_names(df))
    if not shape.n_literals:
        return session.sql(f"SELECT '{shape.text_id}' AS text_id, {columns} FROM ({wrapped(shape.query)}) r({columns})")
    name = f"literals_{uuid.uuid4().hex}"
    kinds = shape.shape.split(HOLE)[1::2]
    texts.filter(F.col("shape_id") == shape.shape_id).select("text_id", *more, *[
        F.get("literals", F.lit(i)).cast("int" if k == "i" else "string").alias(f"v{i}") for i, k in enumerate(kinds)
    ]).createOrReplaceTempView(name)
    pieces = shape.shape.split(HOLE)
    pieces[1::2] = [f"{name}.v{i}" for i in range(len(kinds))]
    told = ", ".join(["text_id", *more])
    return session.sql(f"SELECT {told}, {columns} FROM {name}, LATERAL ({wrapped(''.join(pieces))}) r({columns})")


def _ids(planned_shapes: list) -> list[str]:
    return [shape.shape_id for shape, _ in planned_shapes]


def _bounded(session: SparkSession, planned_shapes: list, texts: DataFrame, with_preview: tuple[int, int]) -> DataFrame:
    """The texts of shapes with literals, with a ``bound``: a row of theirs, as text, that the last one shown does not exceed.

    It is the last of the rows to show among a part of the text's rows, so as
    many of all its rows are not above it, whichever the part.  Null where the
    part is too small to tell.
    """
    rows, chars = with_preview
    some = union_all([_rows_of(shape, df, texts, session).filter(F.rand(42) * RANKED_FOR_BOUND < 1).selectExpr(
        "text_id", _printed(df, chars)) for shape, df in planned_shapes])
    place = F.row_number().over(Window.partitionBy("text_id").orderBy("row"))
    bounds = some.withColumn("_rank", place).filter(F.col("_rank") == rows).select("text_id", F.col("row").alias("bound"))
    return texts.filter(F.col("shape_id").isin(_ids(planned_shapes))).select("shape_id", "text_id", "literals").join(
        bounds, "text_id", "left")


def _printed_rows(shape, df: DataFrame, texts: DataFrame, session: SparkSession, rows: int, chars: int) -> DataFrame:
    """``text_id, at, row``: rows of the texts of a shape, those to show among them unless they equal the bound of their text."""
    if shape.n_literals:
        # The last term, never true, keeps Spark from printing rows before the shape's own comparisons have ruled them out.
        below = F.col("bound").isNull() | (F.col("row") < F.col("bound")) | (F.rand(42) < 0)
        printed = _rows_of(shape, df, texts, session, ("bound",)).selectExpr("text_id", "bound", _printed(df, chars)).filter(
            below).drop("bound")
    else:
        printed = _rows_of(shape, df, texts, session).selectExpr("text_id", _printed(df, chars))
        if ORDERED.search(shape.query):
            return printed.withColumn("at", F.monotonically_increasing_id())
        printed = printed.orderBy("row").limit(rows)  # one text: Spark keeps the least in each map task
    return printed.withColumn("at", F.lit(0).cast("bigint"))


def _summaries(session: SparkSession, planned_shapes: list, texts: DataFrame, with_preview: tuple[int, int] | None,
               bounded: DataFrame | None = None) -> DataFrame:
    """One row per text of the planned shapes.

    The row hashes of all texts share one shuffle, so a batch costs two
    exchanges and not two for each text.  ``bounded`` are the stored texts of
    :func:`_bounded`, which previews of shapes with literals need.
    """
    sizes = session.createDataFrame([(shape.shape_id, len(df.columns)) for shape, df in planned_shapes],
                                    "shape_id string, n_columns int")
    mine = texts.filter(F.col("shape_id").isin(_ids(planned_shapes))).select(
        "db_id", "query", "text_id", "shape_id").join(F.broadcast(sizes), "shape_id")  # a row for each shape of a batch
    hashes = union_all([_rows_of(shape, df, texts, session).selectExpr("text_id", *_hashes(df)) for shape, df in planned_shapes])
    sets = (hashes.groupBy("text_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("text_id").agg(F.sum("n").alias("n_rows"), *_set_of_rows()))
    out = mine.join(sets, "text_id", "left").na.fill(0, ["n_rows", "n_distinct", "x1", "x2"])
    if with_preview:
        rows, chars = with_preview
        printed = union_all([_printed_rows(shape, df, bounded, session, rows, chars) for shape, df in planned_shapes])
        first = F.row_number().over(Window.partitionBy("text_id").orderBy("at", "row"))
        lists = printed.withColumn("_rank", first).filter(F.col("_rank") <= rows).groupBy("text_id").agg(
            F.array_sort(F.collect_list(F.struct("at", "row"))).alias("shown"))
        shown = F.coalesce(F.col("shown.row"), F.array().cast("array<string>"))
        out = out.join(lists, "text_id", "left")
        if bounded is not None:  # rows that equal the bound fill the places that are left
            out = out.join(bounded.select("text_id", "bound"), "text_id", "left")
            filled = F.slice(F.concat(shown, F.array_repeat("bound", rows)), 1, rows)
            shown = F.when(F.col("bound").isNotNull(), filled).otherwise(shown)
        out = out.withColumn("preview", _preview_text(F.col("n_rows"), F.col("n_columns"), shown, chars))
    else:
        out = out.withColumn("preview", F.lit(None).cast("string"))
    return out.select("db_id", "query", "n_columns", "n_distinct", "x1", "x2", "preview",
                      F.lit(None).cast("string").alias("error"))


def _write_summaries(session: SparkSession, planned_shapes: list, texts: DataFrame, path: str,
                     with_preview: tuple[int, int] | None, seconds: float | None, more: list[DataFrame]) -> None:
    """One job for the summaries and ``more`` rows, and before it one for the bounds of previews; the time limit is for both."""
    start, bounded = time.monotonic(), None
    lifted = [(shape, df) for shape, df in planned_shapes if shape.n_literals]
    if with_preview and lifted:
        bounds = _bounded(session, lifted, texts, with_preview)
        bounds_path = f"{path}-bounds-{uuid.uuid4().hex}"
        _write(session, bounds, bounds_path, seconds)
        bounded = session.read.schema(bounds.schema).parquet(bounds_path)
        # At the limit, the second job is cancelled as soon as it starts.
        seconds = seconds and max(seconds - (time.monotonic() - start), 0.001)
    _write(session, union_all([*more, _summaries(session, planned_shapes, texts, with_preview, bounded)]), path, seconds)


def _write(spark: SparkSession, rows: DataFrame, path: str, seconds: float | None) -> None:
    """One job, under a time limit if there is one; cancelling it raises here.

    Each job has its own folder under ``path``, so jobs side by side do not meet.
    """
    group = uuid.uuid4().hex
    context = spark.sparkContext
    context.setJobGroup(group, "recorded queries", interruptOnCancel=True)
    timer = threading.Timer(seconds, context.cancelJobGroup, [group]) if seconds else None
    if timer:
        timer.start()
    try:
        rows.write.parquet(f"{path}/batch={group}")
    finally:
        if timer:
            timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.interruptOnCancel", None)


def _failures(texts: DataFrame, failed: list[tuple[str, str]]) -> DataFrame:
    """The error of every text of the failed shapes (shape_id, error)."""
    errors = F.broadcast(texts.sparkSession.createDataFrame(failed, "shape_id string, error string"))
    return texts.join(errors, "shape_id").selectExpr(
        "db_id", "query", "CAST(NULL AS INT) AS n_columns", "CAST(NULL AS BIGINT) AS n_distinct", "CAST(NULL AS BIGINT) AS x1",
        "CAST(NULL AS BIGINT) AS x2", "CAST(NULL AS STRING) AS preview", "error")


def _each_text(shape, texts: DataFrame) -> Iterator:
    """The texts of a shape as shapes of their own, without literals lifted; one partition at a time is on the driver."""
    for row in texts.filter(F.col("shape_id") == shape.shape_id).toLocalIterator():
        yield Row(db_id=row.db_id, shape_id=row.text_id, shape=row.query, query=row.query, text_id=row.text_id, n_literals=0)


def _run_batch(session: SparkSession, shapes: list, texts_path: str, path: str, with_preview: tuple[int, int] | None,
               seconds: float | None) -> None:
    """Append one row per text of a batch of shapes to the results.

    A batch that fails is run again shape by shape, a shape that fails text by
    text, so that one bad text hides no other.
    """
    texts = session.read.parquet(texts_path)
    by_text = texts.withColumn("shape_id", F.col("text_id"))
    plans = _plan_all(session, [shape.query for shape in shapes])
    failed = [(shape.shape_id, message(df)) for shape, df in zip(shapes, plans) if isinstance(df, Exception)]
    good = [(shape, df) for shape, df in zip(shapes, plans) if not isinstance(df, Exception)]
    try:
        frames = [_failures(texts, failed)] if failed else []
        if good:
            _write_summaries(session, good, texts, path, with_preview, seconds, frames)
        else:
            _write(session, union_all(frames), path, seconds)
        return
    except Exception:
        failed, alone = list(failed), []
    for shape, df in good:
        try:
            _write_summaries(session, [(shape, df)], texts, path, with_preview, seconds, [])
        except Exception as error:
            if not shape.n_literals:
                failed.append((shape.shape_id, _reason(error)))
                continue
            for own in _each_text(shape, texts):
                try:
                    _write_summaries(session, [(own, planned(session, own.query))], by_text, path, with_preview, seconds, [])
                except Exception as single:
                    alone.append((own.text_id, _reason(single)))
    for rows, errors in ((texts, failed), (by_text, alone)):
        if errors:
            _write(session, _failures(rows, errors), path, None)


def _reason(error: Exception) -> str:
    return TIMEOUT if "cancel" in str(error).lower() else message(error)


def run_queries(spark: SparkSession, queries: DataFrame, tables: Tables, with_preview: bool = False,
                seconds: float | None = None, batch: int = BATCH, workers: int = WORKERS,
                shown_rows: int = SHOWN_ROWS, preview_chars: int = PREVIEW_CHARS) -> DataFrame:
    """Run each distinct ``db_id, query`` once.

    One row per text: the fingerprint of its result, a preview of its first
    rows if wanted, and the error if it failed.  Jobs run while this is called.
    A text without an order has no first rows: its least rows as text are
    shown, which a retried task shows again.
    There is no time limit unless ``seconds`` sets one for a batch, and then
    for each shape and text of a batch that took longer.
    """
    path, texts_path = fresh_path(spark, "query-results"), fresh_path(spark, "query-texts")
    spark.createDataFrame([], RESULT).write.parquet(f"{path}/batch=0")
    # Stored by shape, so that a batch reads only the files and row groups of its shapes.
    shaped = with_shapes(queries, whole_if_ordered=with_preview)
    shaped.repartitionByRange("db_id", "shape_id").sortWithinPartitions("db_id", "shape_id").write.parquet(texts_path)
    shapes = spark.read.parquet(texts_path).groupBy("db_id", "shape_id").agg(
        F.min_by(F.struct("query", "text_id", "shape", F.size("literals").alias("n_literals")), "query").alias("s")).select(
        "db_id", "shape_id", "s.*")
    sessions: dict[str, SparkSession] = {}
    batches = _batches(shapes, batch)
    shown = (shown_rows, preview_chars) if with_preview else None
    with ThreadPoolExecutor(workers) as pool:
        while turn := list(islice(batches, workers)):
            named = {rows[0].db_id for rows in turn}
            sessions = {d: sessions.get(d) or candidate_session(spark, d, tables) for d in named}
            list(pool.map(lambda rows: _run_batch(sessions[rows[0].db_id], rows, texts_path, path, shown, seconds), turn))
    parts = spark.read.schema(RESULT).parquet(path)
    whole = parts.groupBy("db_id", "query").agg(  # one row as it stands; a success before an error
        F.max_by(F.struct(*FIELDS), F.col("error").isNull()).alias("r")).select("db_id", "query", "r.*")
    text = F.coalesce("preview", F.concat(F.lit("Error: "), F.col("error"))) if with_preview else F.col("preview")
    return whole.withColumn("preview", text)


def syntax_checks(spark: SparkSession, queries: DataFrame, tables: Tables) -> DataFrame:
    """``syntax_check`` 1.0 where a text runs, else 0.0 and the error."""
    return syntax_of(run_queries(spark, queries, tables))


def with_results(rows: DataFrame, results: DataFrame, query: str = "generated_query") -> DataFrame:
    """Adds ``syntax_check`` (1.0 where the query ran) and ``formatted_result``, its preview or its error.

    Joined by a digest of the text; a text that a third of the rows share is
    split by Spark's skew join.  A null query did not run and shows nothing.
    """
    found = results.select(text_id("query").alias("_id"), F.col("error").isNull().cast("double").alias("syntax_check"),
                           F.col("preview").alias("formatted_result"))
    joined = rows.withColumn("_id", text_id(query)).join(found, "_id", "left").drop("_id")
    return joined.na.fill(0.0, ["syntax_check"]).na.fill("", ["formatted_result"])


def syntax_of(results: DataFrame) -> DataFrame:
    """``db_id, query, syntax_check, error`` from the results of a run."""
    return results.select("db_id", "query", F.col("error").isNull().cast("double").alias("syntax_check"), "error")


def labelled(rows: DataFrame, results: DataFrame, query: str = "generated_query",
             gold: str = "gold_query") -> DataFrame:
    """Adds ``exec_res`` and ``exec_err`` by joining results of both queries.

    Equal means the same set of rows, neither empty.  Where a run took too long
    there is no label.  The texts' digests are the join keys; a gold query that
    a third of the rows share is split by Spark's skew join, which needs no
    count of the rows beforehand.
    """
    fields = ["n_columns", "n_distinct", "x1", "x2", "error"]
    out = rows
    for side, column in (("p", query), ("g", gold)):
        named = results.select(text_id("query").alias("_id"), *[F.col(c).alias(f"_{side}_{c}") for c in fields])
        out = out.withColumn("_id", text_id(column)).join(named, "_id", "left")
    same = F.col("_p_n_distinct") > 0
    for c in fields[:-1]:
        same = same & (F.col(f"_p_{c}") == F.col(f"_g_{c}"))
    late = F.coalesce((F.col("_p_error") == TIMEOUT) | (F.col("_g_error") == TIMEOUT), F.lit(False))
    res = F.when(~late, F.coalesce(same, F.lit(False)).cast("int"))
    err = F.coalesce("_p_error", "_g_error", F.when(res == 1, F.lit(RIGHT)).otherwise(F.lit(WRONG)))
    return out.select(*rows.columns, res.alias("exec_res"), err.alias("exec_err"))
