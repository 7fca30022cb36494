"""Quality rules: robust multivariate outliers among statistics of texts.

Every text gives a vector of transformed statistics.  For each language and
source the minimum covariance determinant estimate is found by concentration
steps: from several starts, the rows nearest to the present centre are kept and
the moments taken anew, and the start with the least determinant wins.  A last
reweighted estimate gives the distances.  Moments are sums of fixed-point
numbers, so that the result does not depend on how rows are partitioned, and
the share of nearest rows is cut at a bin of a histogram of distances, so that
no group is sorted in one task.

Null texts have no words and fail; null languages and sources are groups of
their own; groups below ``min_rows`` use their language's estimate, or that of
all rows.  Repeated rows get equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrove.functions.text import let
from querygrove.session import write_and_read

from .common import WORD, words

DIMS = 5
SCALE = 10_000
#: Variances that no estimate goes below: most texts have no symbol or repeated line at all.
FLOOR = (0.09, 0.01, 0.04, 0.06, 0.01)
SHARE, STARTS, STEPS, MIN_ROWS = 0.75, 3, 3, 200
#: Makes the covariance of the nearest three quarters consistent for five normal dimensions.
CONSISTENT = 1.4
CUTOFF = 45.0
BINS_PER_OCTAVE = 16
XS = [f"x{i}" for i in range(DIMS)]
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
ESTIMATE = [f"m{i}" for i in range(DIMS)] + [f"l{i}{j}" for i, j in PAIRS]


def statistics(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``row`` (all columns of ``docs``), group keys, the base statistics and the vector x0..x4."""
    t = F.coalesce(F.col("row")[text], F.lit(""))
    start = docs.select(F.struct("*").alias("row")).select(
        "row", t.alias("t"), words(t).alias("w"),
        F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD)).alias("lines"))
    hashed = start.withColumn("n_words", F.size("w").cast("long")).withColumn("h", F.when(
        F.col("n_words") >= 8, F.transform(F.sequence(F.lit(1), F.size("w") - 7),
                                           lambda i: F.xxhash64(F.slice("w", i, 8)))))
    ordered = hashed.withColumn("word_chars", F.length(F.array_join("w", "")).cast("long")).drop("w").withColumn("s", F.when(
        F.size(F.array_distinct("h")) < F.size("h"),
        F.sort_array(F.transform("h", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))))
    # The sorted windows are bound once: each looks at its neighbours in them.
    flagged = ordered.drop("h").withColumn("at", let(F.col("s"), lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, k: (x["v"] == F.get(s, k + 1)["v"]) | (x["v"] == F.get(s, k - 1)["v"])),
        lambda x: x["i"]))))
    bare = F.col("t")
    for symbol in "#*$%&|<>":
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    symbols = F.octet_length("t") - F.octet_length(bare)
    based = flagged.select(
        "row", "n_words",
        "word_chars",
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("at", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, p: F.struct(
            (p + 8).alias("end"), (a["n"] + p + 8 - F.greatest(p, a["end"])).alias("n")),
            lambda a: a["n"]), F.lit(0)).cast("long").alias("n_repeat_words"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    vector = (F.log(n), F.log(1 + F.col("word_chars") / n), F.log1p(20 * F.col("n_symbols") / n),
              F.log1p(4 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
              F.sqrt(F.col("n_repeat_words") / n))
    return based.select(
        "*", ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.to_json(F.struct(F.col("row")[lang].alias("l"))).alias("lang_key"),
        F.to_json(F.struct(F.col("row")[lang].alias("l"), F.col("row")[source].alias("s"))).alias("source_key"),
        *[F.round(v * SCALE).cast("long").alias(x) for v, x in zip(vector, XS)])


def _estimates(rows: DataFrame, by: list[str], inflate: float) -> DataFrame:
    """Centre and Cholesky factor of each group's covariance, from exact sums."""
    def exact(c):
        return F.sum(c.cast("decimal(20,0)")).cast("double")
    sums = rows.groupBy(*by).agg(
        F.count("*").cast("double").alias("n"), *[exact(F.col(x)).alias(f"s{i}") for i, x in enumerate(XS)],
        *[exact(F.col(XS[i]) * F.col(XS[j])).alias(f"q{i}{j}") for i, j in PAIRS])
    out = sums.select(*by, "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(DIMS)], *[
        (F.greatest((F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) / F.col("n"), F.lit(0.0))
         * inflate + FLOOR[i] * SCALE * SCALE if i == j else
         (F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) / F.col("n") * inflate).alias(f"c{i}{j}")
        for i, j in PAIRS])
    for i, j in PAIRS:
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
    log_det = reduce(lambda a, b: a + b, [F.log(F.col(f"l{i}{i}")) for i in range(DIMS)])
    return out.select(*by, "n", *ESTIMATE, log_det.alias("log_det"))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance under the estimate beside each row."""
    for i in range(DIMS):
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(f"x{i}") - F.col(f"m{i}"))
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    d2 = reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIMS)])
    return rows.withColumn("d2", d2).drop(*[f"y{i}" for i in range(DIMS)])


def _nearest(rows: DataFrame, by: list[str], estimates: DataFrame) -> DataFrame:
    """The rows up to the histogram bin that holds the wanted share of each group."""
    binned = _distance(rows.join(estimates.select(*by, *ESTIMATE), by)).drop(*ESTIMATE).withColumn(
        "bin", F.floor(F.log2(F.col("d2") + 1e-3) * BINS_PER_OCTAVE))
    counts = binned.groupBy(*by, "bin").agg(F.count("*").alias("c"))
    key = ", ".join(by)
    # Stored: the planner then knows its size and need not deal the rows by their group.
    cut = write_and_read(counts.selectExpr(
        *by, "bin", f"sum(c) OVER (PARTITION BY {key} ORDER BY bin) AS upto", f"sum(c) OVER (PARTITION BY {key}) AS n"
    ).filter(F.col("upto") >= F.col("n") * SHARE).groupBy(*by).agg(F.min("bin").alias("last")), "mcd")
    return binned.join(cut, by).filter(F.col("bin") <= F.col("last")).drop("bin", "last", "d2")


def fit(stats: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """One estimate per group key: sources, languages and all rows, if large enough.

    ``stats`` is read once for each step, so pass a stored table.  The estimates
    are as many rows as there are groups.
    """
    rows = stats.filter(~F.col("base_failed")).select(
        F.explode(F.array("source_key", "lang_key", F.lit("all"))).alias("key"), *XS)
    sizes = write_and_read(rows.groupBy("key").count().filter(
        (F.col("count") >= min_rows) | (F.col("key") == "all")).select("key"), "mcd")
    spread = rows.join(sizes, "key").withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    by = ["key", "start"]
    subset = spread.filter((F.col("start") == 0) | (F.pmod(F.xxhash64(*XS), F.lit(STARTS)) == F.col("start")))
    estimates = write_and_read(_estimates(subset, by, 1.0), "mcd")
    for _ in range(STEPS):
        estimates = write_and_read(_estimates(_nearest(spread, by, estimates), by, CONSISTENT), "mcd")
    best = write_and_read(estimates.groupBy("key").agg(
        F.min_by(F.struct(*ESTIMATE), F.struct("log_det", "start")).alias("e")).select("key", "e.*"), "mcd")
    near = _distance(rows.join(best, "key")).drop(*ESTIMATE).filter(F.col("d2") <= CUTOFF)
    return write_and_read(_estimates(near, ["key"], 1.0).select("key", "n", *ESTIMATE), "mcd")


def judge(stats: DataFrame, estimates: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Adds ``distance2`` and ``kept``; each row uses its most special estimate."""
    packed = estimates.select("key", F.struct(*ESTIMATE).alias("e"))
    def named(k, e):
        return packed.select(F.col("key").alias(k), F.col("e").alias(e))
    out = stats.join(named("source_key", "e1"), "source_key", "left").join(
        named("lang_key", "e2"), "lang_key", "left").withColumn("all_key", F.lit("all")).join(
        named("all_key", "e3"), "all_key", "left")
    out = out.withColumn("e", F.coalesce("e1", "e2", "e3")).select(
        *stats.columns, *[F.col("e")[c].alias(c) for c in ESTIMATE])
    out = _distance(out).drop(*ESTIMATE)
    # One condition, not a conjunction: a part of it pushed below would take the statistics twice.
    kept = F.when(F.col("base_failed"), False).otherwise(F.coalesce(F.col("d2") <= cutoff, F.lit(True)))
    return out.withColumn("kept", kept).withColumnRenamed("d2", "distance2")


def verdicts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row with statistics and verdict.  Texts are read once."""
    stats = statistics(docs)
    stored = write_and_read(stats.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in keep])), "stats")
    return judge(stored, fit(stored))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass.  Statistics are taken twice rather than texts stored or shuffled."""
    stats = statistics(docs)
    stored = write_and_read(stats.drop("row"), "stats")
    return judge(stats, fit(stored)).filter("kept").select("row.*")
