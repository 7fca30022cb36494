"""Linking the words of a question to values stored in its database.

A batch similarity join: probe strings meet indexed values by the rarest of
their shingles, the ten closest by Jaccard similarity stay, and two further
similarities narrow them down.  MinHash signatures and bands of the values can
be stored beside them and checked on the same pairs.  Every step is keyed by
``db_id``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import minhash
from ..functions.text import let, strip
from ..session import write_and_read
from . import setjoin
from .joins import SALT_BUCKETS, hot_counted, hot_keys, hot_salted_lookup, salted_lookup, spread, union_all
from .profiling import COLUMN

# Which columns are indexed, and the limits of each step.
UNWANTED_IN_NAME = "_id| id|url|email|web|time|phone|date|address"
NAME_SUM_LIMIT = 5_000_000
SUM_LIMIT = 2_000_000
AVERAGE_LIMIT = 25
DISTINCT_LIMIT = 100
SKIP_SUM = 50_000
SKIP_AVERAGE = 20
TOP_MATCHES = 10
# Percents of Jaccard similarity: what counts as near, and the thresholds that
# the search for the closest falls through.
NEAR_PERCENT = 80
FALLING_PERCENTS = [80, 45]
EDIT_THRESHOLD = 0.3
EMBEDDING_THRESHOLD = 0.6
NEAR_BEST = 0.9
# How many files one database of a stored index has at most.
FILES_PER_DATABASE = 8
# A database of more rows, or of more pairs of values and probes, is shared by many tasks.
ROWS_PER_TASK = 100_000
PAIRS_PER_TASK = 4_000_000
# Nor does one task hold the shingles of more text than this.
CHARS_PER_TASK = 4_000_000
# Shared bands of a database that are looked at together.
MEETINGS = 1_000_000
# Rows of the refinement that one task holds.
STEP_ROWS = 500_000


def eligible_columns(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Text columns, by either dialect's type names, whose name is no key of the database and hints at no code."""
    key_names = keys.filter(F.col("kind") == "pk").select(
        "db_id", F.lower("column_name").alias("_c")).distinct()
    wanted = columns.filter(
        (F.contains("data_type", F.lit("TEXT")) | F.col("data_type").rlike("^(string|varchar|char)"))
        & ~F.lower("column_name").rlike(UNWANTED_IN_NAME)
        & ~F.endswith("column_name", F.lit("Id")))
    return (wanted.withColumn("_c", F.lower("column_name"))
            .join(key_names, ["db_id", "_c"], "left_anti").drop("_c"))


def _average() -> Column:
    return F.col("sum_of_lengths") / F.col("count_distinct")


def size_gate(lengths: DataFrame) -> DataFrame:
    """Adds ``fit``: whether a column is small enough for a one-machine index.

    A flag only: :func:`unique_values` indexes every eligible column, and a
    caller who wants the smaller index filters ``eligible`` by it.
    """
    named = F.contains(F.lower("column_name"), F.lit("name"))
    return lengths.withColumn(
        "fit", (F.col("count_distinct") > 0)
        & ((named & (F.col("sum_of_lengths") < NAME_SUM_LIMIT))
           | ((F.col("sum_of_lengths") < SUM_LIMIT) & (_average() < AVERAGE_LIMIT))
           | (F.col("count_distinct") < DISTINCT_LIMIT)))


def skip_column() -> Column:
    """True for a column of long text that no name column is."""
    named = F.contains(F.lower("column_name"), F.lit("name"))
    return ~named & (F.col("sum_of_lengths") > SKIP_SUM) & (_average() > SKIP_AVERAGE)


def unique_values(distinct: DataFrame, eligible: DataFrame) -> DataFrame:
    """The values to index: distinct ones of every eligible column, whatever its size."""
    return salted_lookup(distinct, eligible.select(*COLUMN), COLUMN, "inner")


def identity(*columns: str) -> Column:
    """A fixed-width stand-in for texts in joins: a digest of all of them."""
    return F.md5(F.to_json(F.struct(*columns)).cast("binary"))


def value_index(values: DataFrame) -> DataFrame:
    """Adds the signature and the band keys of each value, and an identity."""
    return (spread(values, *COLUMN, "value")
            .withColumn("value_id", identity(*COLUMN, "value"))
            .withColumn("signature", minhash.signature(F.col("value")))
            .withColumn("bands", minhash.bands(F.col("signature"))))


def probe_strings(keywords: DataFrame, keyword: str = "keyword") -> DataFrame:
    """The texts to look up for each keyword, each once.

    The keyword itself, both sides of each space, and the value of a
    ``column = value`` hint.
    """
    text = strip(F.col(keyword))
    rows = keywords.withColumn(keyword, text)
    after_first = strip(F.regexp_extract(F.col(keyword), r"(?s)^[^=]*=(.*)$", 1))

    def sides(k: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(k), F.lit(1))),
                          lambda i: F.substring(k, i, F.lit(1)) == " ")
        return F.flatten(F.transform(places, lambda i: F.array(
            F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k)))))

    hints = F.when(after_first != "", F.array(after_first)).otherwise(F.array().cast("array<string>"))
    every = F.array_union(F.array(F.col(keyword)), F.array_union(let(F.col(keyword), sides), hints))
    return rows.withColumn("substring", F.explode(every))


def ranked_probes(probes: DataFrame, by: tuple[str, ...] = ("db_id", "keyword")) -> DataFrame:
    """Adds ``probe_rank``: the longest text of a keyword first, equally long ones from the last in code point order.

    A keyword has about two probes for each space in it, so no rank sorts more.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(F.length("substring")), F.desc("substring"))
    return probes.withColumn("probe_rank", F.row_number().over(order))


def hint_parts(text: Column) -> tuple[Column, Column]:
    """Column and value of a ``column = value`` hint; nulls without one."""
    has = F.contains(text, F.lit("="))
    left = F.when(has, strip(F.regexp_extract(text, r"(?s)^([^=]*)=", 1)))
    right = F.when(has & ~text.rlike(r"(?s)^[^=]*=$"), strip(F.regexp_extract(text, r"(?s)^[^=]*=(.*)$", 1)))
    return left, right


def probe_index(probes: DataFrame) -> DataFrame:
    """Each text to look up in a database once, with signature and bands."""
    return (spread(probes.select("db_id", "substring").distinct(), "db_id", "substring")
            .withColumn("probe_id", identity("db_id", "substring"))
            .withColumn("probe_signature", minhash.signature(F.col("substring")))
            .withColumn("probe_bands", minhash.bands(F.col("probe_signature"))))


def shingle_sets(values: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The probes (left_id, db_id, substring, tokens), the values (right_id, db_id, other columns of COLUMN, value,
    tokens), each once and stored, with tokens by rarity among the values of the database, and the rarity."""
    none = F.lit(None).cast("string")
    named = values.select("db_id", identity(*COLUMN, "value").alias("id"), none.alias("substring"), "table_name",
                          "column_name", "value", minhash.shingles(F.col("value")).alias("tokens"))
    asked = probes.select("db_id", "substring").distinct().select(
        "db_id", identity("db_id", "substring").alias("id"), "substring", none.alias("table_name"),
        none.alias("column_name"), none.alias("value"), minhash.shingles(F.col("substring")).alias("tokens"))
    counts = setjoin.token_counts(named, "db_id")
    both = setjoin.rarest_first(named.unionByName(asked), counts, "db_id", "id")
    left = both.filter("substring IS NOT NULL").select(F.col("id").alias("left_id"), "db_id", "substring", "tokens")
    right = both.filter("substring IS NULL").drop("substring").withColumnRenamed("id", "right_id")
    return left, right, counts


def _jaccard(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("jaccard", F.col("common") / F.col("either")).drop("common", "either")


def near_pairs(probes: DataFrame, values: DataFrame, percent: int = NEAR_PERCENT) -> DataFrame:
    """``left_id, right_id, db_id, substring, table_name, column_name, value, jaccard``: all pairs of one database that
    are ``percent`` alike.

    Exact.  Both frames are read more than once and should be stored.
    """
    left, right, counts = shingle_sets(values, probes)
    return _jaccard(setjoin.similar_pairs(left, right, counts, "db_id", percent))


def lsh_candidates(probes: DataFrame, index: DataFrame) -> DataFrame:
    """``db_id, substring, table_name, column_name, value``: every pair of one database that shares a band, each once.

    ``probes`` and ``index`` come from :func:`probe_index` and :func:`value_index`.  Each side is stored with a number
    for its rows.  Signatures are not carried along: :func:`estimated` has them from the texts.  A database is dealt
    whole to one task, so no pair is shuffled; one that is too large for that has its pairs met by band.
    """
    number = F.monotonically_increasing_id()
    values = write_and_read(index.select(*COLUMN, "value", "bands", number.alias("_v")), "banded-values")
    asked = write_and_read(probes.select("db_id", "substring", "probe_bands", number.alias("_p")), "banded-probes")
    large = _large_databases(values, asked)
    parts = []
    for how, pairs in (("left_anti", _pairs_in_database), ("left_semi", _pairs_by_band)):
        found = pairs(*[rows.join(large, "db_id", how) for rows in (values, asked)])
        parts.append(found.select("db_id", "substring", "table_name", "column_name", "value"))
    return union_all(parts)


def _large_databases(values: DataFrame, asked: DataFrame, texts: tuple[str, str] | None = None) -> DataFrame:
    """``db_id`` of the databases that are too large for one task, by the length of ``texts`` of both sides too."""
    def sized(rows: DataFrame, count: str, text: str | None) -> DataFrame:
        chars = F.sum(F.length(text)) if text else F.lit(0).cast("bigint")
        return rows.groupBy("db_id").agg(F.count(F.lit(1)).alias(count), chars.alias(f"{count}_chars"))

    of_values, of_probes = texts or (None, None)
    sizes = write_and_read(sized(values, "_values", of_values).join(sized(asked, "_probes", of_probes), "db_id"), "database-sizes")
    rows, pairs = F.col("_values") + F.col("_probes"), F.col("_values").cast("double") * F.col("_probes")
    chars = F.col("_values_chars") + F.col("_probes_chars")
    return sizes.filter((rows > ROWS_PER_TASK) | (pairs > PAIRS_PER_TASK) | (chars > CHARS_PER_TASK)).select("db_id")


def _pairs_in_database(values: DataFrame, asked: DataFrame) -> DataFrame:
    """The pairs of databases that a task holds whole: both sides come together, so no pair is shuffled."""
    def met(probes: pa.Table, rows: pa.Table) -> pa.Table:
        left, right = shared_bands(probes["probe_bands"], rows["bands"])
        return pa.table([rows["db_id"].take(right), probes["substring"].take(left),
                         *[rows[c].take(right) for c in ("table_name", "column_name", "value")]],
                        names=["db_id", "substring", "table_name", "column_name", "value"])

    sides = [rows.filter("db_id IS NOT NULL").groupBy("db_id") for rows in (
        asked.select("db_id", "substring", "probe_bands"), values.select(*COLUMN, "value", "bands"))]
    return sides[0].cogroup(sides[1]).applyInArrow(
        met, "db_id string, substring string, table_name string, column_name string, value string")


def shared_bands(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all rows of both sides that share a band, by the left one, each pair once."""
    def flat(bands: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        lists = bands.combine_chunks()
        return pc.list_flatten(lists).to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)

    keys, at = flat(right)
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    asked, rows = flat(left)
    first = np.searchsorted(keys, asked, "left")
    held = np.searchsorted(keys, asked, "right") - first
    # Runs of left rows with about MEETINGS meetings each, so that what meets more than once stays small.
    run = (np.cumsum(held) - held) // MEETINGS
    new_row = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, dtype=bool)
    run = np.maximum.accumulate(np.where(new_row, run, 0)) if len(rows) else run
    found = []
    for each in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(run)) + 1):
        n = held[each]
        places = np.arange(n.sum()) + np.repeat(first[each] - (np.cumsum(n) - n), n)
        found.append(np.unique(np.repeat(rows[each], n) * len(right) + at[places]))
    pairs = np.concatenate(found)
    return (pairs // len(right), pairs % len(right)) if len(right) else (pairs, pairs)


def _pairs_by_band(values: DataFrame, asked: DataFrame) -> DataFrame:
    """The pairs of databases that many tasks share: two numbers meet by band, texts are joined to different pairs."""
    value_rows = values.select("db_id", F.explode("bands").alias("_band"), "_v")
    probe_rows = asked.select("db_id", F.explode("probe_bands").alias("_band"), "_p")
    pairs = hot_salted_lookup(value_rows, probe_rows, ["db_id", "_band"], "inner").select("_p", "_v").distinct()
    # A text with very many pairs is left to Spark's skew join, as pairs are known only at run time.
    return pairs.join(values.drop("bands"), "_v").join(asked.drop("probe_bands"), ["db_id", "_p"])


def estimated(pairs: DataFrame) -> DataFrame:
    """Pairs of :func:`lsh_candidates` with the similarity that their signatures estimate.

    A text is signed where its pairs are, which come by database and probe, so neither texts nor signatures are
    shuffled.  Pairs in another order have the same estimates, but their texts are signed more often.
    """
    return pairs.select("db_id", "substring", "table_name", "column_name", "value", minhash.estimated_of_texts(
        F.col("substring"), F.col("value")).alias("estimated_jaccard"))


def top_matches(probes: DataFrame, values: DataFrame, limit: int = TOP_MATCHES,
                percents: list[int] = FALLING_PERCENTS) -> DataFrame:
    """The closest values of each probe among those that reach the last of ``percents``, with ``jaccard``.

    Equal similarities go by value, table and column.  A database that a task can hold is dealt whole to one, so no
    pair is shuffled; the pairs of the others are joined.  ``values`` and ``probes`` are read more than once and should
    be stored.  Jobs run while this is called.
    """
    sides = [values.select(*COLUMN, "value").filter("db_id IS NOT NULL AND value IS NOT NULL"),
             probes.select("db_id", "substring").filter("db_id IS NOT NULL AND substring IS NOT NULL")]
    large = _large_databases(*sides, ("value", "substring"))
    found = write_and_read(_closest_in_database(*[rows.join(large, "db_id", "left_anti") for rows in sides], limit, percents[-1]),
                           "closest-in-databases")
    if large.isEmpty():
        return _jaccard(found)
    left, right, counts = shingle_sets(*[rows.join(large, "db_id", "left_semi").distinct() for rows in sides])
    joined = setjoin.closest_pairs(left, right, counts, "db_id", limit, percents,
                                   [F.col(c) for c in ("value", "table_name", "column_name")])
    return _jaccard(union_all([found, joined.select(*found.columns)]))


def _closest_in_database(values: DataFrame, asked: DataFrame, limit: int, percent: int) -> DataFrame:
    """The closest values of each probe as ``common`` of ``either`` shingles, in databases that a task holds whole."""
    def once(rows: pa.Table, columns: list[str]) -> pa.Table:
        """Each row once, ordered by ``columns``."""
        placed = rows.append_column("_at", pa.array(np.arange(len(rows))))
        first = placed.group_by(columns, use_threads=False).aggregate([("_at", "min")])
        first = first.take(pc.sort_indices(first, [(c, "ascending") for c in columns], null_placement="at_start"))
        return rows.take(first["_at_min"])

    def met(probes: pa.Table, rows: pa.Table) -> pa.Table:
        probes, rows = once(probes, ["substring"]), once(rows, ["value", "table_name", "column_name"])
        left, right, common, either = setjoin.closest_in_task(probes["tokens"], rows["tokens"], limit, percent)
        return pa.table([rows["db_id"].take(right), probes["substring"].take(left),
                         *[rows[c].take(right) for c in ("table_name", "column_name", "value")], common, either],
                        names=["db_id", "substring", "table_name", "column_name", "value", "common", "either"])

    # Shingles are cut where the rows are dealt to, and not dealt with them.  A partition count given here is kept.
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = [rows.repartition(tasks, "db_id").withColumn("tokens", minhash.shingles(F.col(text))).groupBy("db_id")
             for rows, text in ((asked, "substring"), (values, "value"))]
    return sides[0].cogroup(sides[1]).applyInArrow(
        met, "db_id string, substring string, table_name string, column_name string, value string, common bigint, either bigint")


def matches(keywords: DataFrame, values: DataFrame, limit: int = TOP_MATCHES,
            percents: list[int] = FALLING_PERCENTS) -> DataFrame:
    """``keywords`` with the values closest to each of their probe strings.

    ``values`` (COLUMN, value) is read more than once, so it should be a stored
    frame, such as an index.  Jobs run while this is called.
    """
    probes = write_and_read(probe_strings(keywords), "probes")
    found = top_matches(probes, values, limit, percents).withColumnRenamed("value", "similar_value").drop("jaccard")
    return salted_lookup(probes, found, ["db_id", "substring"], "inner")


def levenshtein_similarity(left: Column, right: Column, at_least: float = 0.0) -> Column:
    """One minus the distance of the lower-cased texts, relative to the longer one; null below ``at_least``.

    With a bound only the band of the distance table that can stay within it is
    filled, and texts whose lengths alone are too far apart are not compared.
    """
    a, b = F.lower(left), F.lower(right)
    longest = F.greatest(F.length(a), F.length(b))
    if at_least <= 0:
        distance = F.levenshtein(a, b)
    else:  # rounded up, so that the comparison below decides
        budget = F.ceil(longest * F.lit(1 - at_least)).cast("int")
        distance = F.nullif(F.call_function("levenshtein", a, b, budget), F.lit(-1))
    score = F.when(longest == 0, F.lit(1.0)).otherwise(1 - distance / longest)
    return F.when(score >= at_least, score) if at_least > 0 else score


@F.pandas_udf(DoubleType())
def block_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of characters in the matching blocks of two lower-cased texts."""
    from difflib import SequenceMatcher
    return pd.Series([SequenceMatcher(None, a.lower(), b.lower()).ratio() for a, b in zip(left, right)],
                     dtype="float64")


def edit_filter(pairs: DataFrame, threshold: float = EDIT_THRESHOLD, blocks: bool = False,
                left: str = "substring", right: str = "similar_value") -> DataFrame:
    """Keeps pairs of enough edit similarity, and adds it.

    The native measure is one minus the relative Levenshtein distance, found in
    a band that the threshold bounds.
    ``blocks`` takes the matching-blocks ratio instead, from Python's standard
    library in Arrow batches; at most ten pairs per probe reach it.
    """
    a, b = F.col(left), F.col(right)
    return (pairs.withColumn("edit_similarity", block_ratio(a, b) if blocks else levenshtein_similarity(a, b, threshold))
            .filter(F.col("edit_similarity") >= threshold))


def dot(left: Column, right: Column) -> Column:
    """Dot product of two vectors, summed in double."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def embedding_filter(pairs: DataFrame, vectors: DataFrame, threshold: float = EMBEDDING_THRESHOLD,
                     left: str = "substring", right: str = "similar_value") -> DataFrame:
    """Keeps pairs whose stored vectors (``text, embedding``) are close.

    ``pairs`` are read once for each side, to count its texts, and should be cheap to read, as a stored table is.
    """
    hot = {side: hot_keys(pairs, [side]) for side in (left, right)}
    for side, name in ((left, "_left"), (right, "_right")):
        pairs = hot_salted_lookup(pairs, vectors.select(F.col("text").alias(side), F.col("embedding").alias(name)),
                              [side], "inner", hot=hot[side])
    return (pairs.withColumn("embedding_similarity", dot(F.col("_left"), F.col("_right")))
            .drop("_left", "_right").filter(F.col("embedding_similarity") >= threshold))


def refine(entities: DataFrame, by: list[str]) -> DataFrame:
    """Keeps values near the best edit similarity of their column and, among
    those, near the best embedding similarity.

    One aggregate finds both bests: a group's steps are its different edit
    similarities, each with the best embedding similarity at it, and the steps
    near the best one are summed up.  Edit similarities are quotients of
    lengths, so a group has few steps however many rows it has, and they are
    combined before the shuffle.  The same aggregate has the group's size,
    which tells the hot groups to salt in the one join back; Spark reuses its
    shuffle there.  The rows are counted first, as the number of tasks follows
    them: they should be cheap to read twice, as a stored table is.  Where that
    is more than the cores, the bests are stored while this is called.
    """
    edit, embedding = F.col("edit_similarity"), F.col("embedding_similarity")
    tasks = _tasks_of_rows(entities)
    steps = _steps(entities, by, tasks)
    top = F.max(edit).over(Window.partitionBy(*by))
    best = steps.withColumn("_edit", top).groupBy(*by).agg(
        F.first("_edit").alias("_edit"), F.sum("_n").alias("_n"),
        F.max(F.when(edit >= F.lit(NEAR_BEST) * F.col("_edit"), F.col("_embedding"))).alias("_embedding"))
    if tasks:
        best = write_and_read(best, "bests")
    joined = hot_salted_lookup(entities, best.drop("_n"), by, "inner", hot=hot_counted(best, by, "_n"), tasks=tasks)
    return joined.filter((edit >= F.lit(NEAR_BEST) * F.col("_edit")) & (
        embedding >= F.lit(NEAR_BEST) * F.col("_embedding"))).drop("_edit", "_embedding")


def _tasks_of_rows(rows: DataFrame) -> int | None:
    """A task for each ``STEP_ROWS`` rows, so that none grows with the input; none said where the cores are enough."""
    tasks = -(-rows.count() // STEP_ROWS)
    return tasks if tasks > rows.sparkSession.sparkContext.defaultParallelism else None


def _steps(entities: DataFrame, by: list[str], tasks: int | None) -> DataFrame:
    """The different edit similarities of each group with the best embedding similarity at it and their rows.

    In ``tasks`` tasks, if said, by group; a step of very many rows is then combined in eight parts first.
    """
    edit, embedding = F.col("edit_similarity"), F.col("embedding_similarity")
    counted = [F.max(embedding).alias("_embedding"), F.count(F.lit(1)).alias("_n")]
    if tasks is None:
        return entities.groupBy(*by, edit).agg(*counted)
    salt = F.pmod(F.xxhash64(*entities.columns), F.lit(SALT_BUCKETS)).alias("_salt")
    dealt = entities.select(*by, edit, embedding, salt).repartition(tasks, *by, "edit_similarity", "_salt")
    parts = dealt.groupBy(*by, edit, "_salt").agg(*counted).drop("_salt")
    return parts.repartition(tasks, *by).groupBy(*by, edit).agg(F.max("_embedding").alias("_embedding"), F.sum("_n").alias("_n"))


def similar_entities(keywords: DataFrame, index: DataFrame, vectors: DataFrame,
                     by: tuple[str, ...] = (), blocks: bool = False) -> DataFrame:
    """All steps for many requests at once: matches, both filters, refinement.

    ``by`` names the columns of ``keywords`` that tell requests of a database
    apart.  Returns the kept entities; :func:`match_map` sums them up.
    """
    found = write_and_read(edit_filter(matches(keywords, index), blocks=blocks), "edited")
    near = write_and_read(embedding_filter(found, vectors), "entities")
    return refine(near, [*by, "db_id", "table_name", "column_name"])


def match_map(entities: DataFrame, by: list[str]) -> DataFrame:
    """Matched values per table and column with how often each was matched.

    Long form: one row per value, as a column may match any number of them.
    """
    return entities.groupBy(*by, "table_name", "column_name", "similar_value").agg(
        F.count(F.lit(1)).alias("n_matches"))


def write_index(index: DataFrame, path: str) -> None:
    """Stores an index by database, in at most ``FILES_PER_DATABASE`` files each.  Runs one job.

    :mod:`.value_store` keeps one that grows.
    """
    part = F.pmod(F.xxhash64("value_id"), F.lit(FILES_PER_DATABASE))
    partitions = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index.repartition(partitions, "db_id", part).write.mode("overwrite").partitionBy("db_id").parquet(path)


def read_index(spark, path: str, db_ids: list[str] | None = None) -> DataFrame:
    """A stored index; with ``db_ids`` only their partitions are listed."""
    index = spark.read.parquet(path).withColumn("db_id", F.col("db_id").cast("string"))
    return index.filter(F.col("db_id").isin(db_ids)) if db_ids is not None else index
