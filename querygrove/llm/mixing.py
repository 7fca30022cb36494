"""Mixing sources to target weights: budgets down a domain, language, source tree.

The token budget goes from the root to the leaves in proportion to integer
weights.  A node gets at most the tokens below it times ``max_epochs``; what it
cannot use goes to its siblings in proportion, and only when all of them are
full is the shortage felt by the level above.  Shares are whole numbers, so a
level loses less than one token for each sibling.

A leaf orders its documents anew in each epoch by a seeded hash and takes a
prefix of the tokens: whole epochs first, then documents up to a cut, the last
of them in part.  The cut is found in a bucket of the hash range that holds it,
so no leaf is sorted as a whole, and documents are picked by comparing their
hash with their leaf's cut.

Null names are nodes of their own; texts without words weigh nothing and are
never taken; rows sharing an id are rows of their own, at the same place in the order
(a cut between them falls by their number of tokens).  Weights default to one.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querygrove.session import write_and_read

from .common import words

LEVELS = ("domain", "lang", "source")
ROWS_PER_BUCKET = 10_000
#: Target weights of the production mix; names not listed weigh one.
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}, "source": {}}
SEED, MAX_EPOCHS, BUDGET_PERCENT = 17, 2, 60


def domain_of(source: Column) -> Column:
    """The domain of a source: by its number, modulo three; without a number, web."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    n = F.when(number == "", 0).otherwise(number.cast("int") % 3)
    return F.when(n == 0, "web").when(n == 1, "books").otherwise("code")


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level).eqNullSafe(F.lit(name)), w).otherwise(out)
    return out.cast("decimal(10,0)")


def budgets(leaves: DataFrame, budget: Column, max_epochs: int, weights: dict) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``share``, the tokens each may give."""
    nodes = leaves.select(*LEVELS, "tokens", (F.col("tokens") * max_epochs).cast("decimal(30,0)").alias("room"))
    out = nodes.withColumn("share", F.least(budget.cast("decimal(30,0)"), F.expr("sum(room) OVER ()")))
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[:depth + 1])
        level_nodes = out.groupBy(*path, "share").agg(F.sum("room").cast("decimal(30,0)").alias("cap")).withColumn(
            "w", _weight(level, weights))
        over = f"OVER (PARTITION BY {', '.join(path[:-1]) or '1'} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {level}"
        level_nodes = level_nodes.selectExpr(
            "*", f"coalesce(sum(cap) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before",
            f"sum(w) {over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest")
        # Nodes come by room per weight, so the full ones are first; the others share what is left.
        level_nodes = level_nodes.selectExpr(
            "*", "CAST(cap AS DECIMAL(20,0)) * w_rest <= w * CAST(share - cap_before AS DECIMAL(20,0)) AS full")
        rest = level_nodes.selectExpr(
            *path, "cap", "w", "full", "share",
            f"coalesce(sum(CASE WHEN full THEN cap END) OVER (PARTITION BY {', '.join(path[:-1]) or '1'}), 0) AS used",
            f"sum(CASE WHEN NOT full THEN w END) OVER (PARTITION BY {', '.join(path[:-1]) or '1'}) AS w_open")
        given = rest.selectExpr(
            *[f"{p} AS g_{p}" for p in path],
            "CAST(CASE WHEN full THEN cap ELSE least(cap, CAST(share - used AS DECIMAL(20,0)) * w div w_open) END"
            " AS DECIMAL(30,0)) AS g_share")
        same = [out[p].eqNullSafe(given[f"g_{p}"]) for p in path]
        on = same[0]
        for s in same[1:]:
            on = on & s
        out = out.join(given, on).select(*LEVELS, "tokens", "room", F.col("g_share").alias("share"))
    return out.select(*LEVELS, "tokens", F.col("share").cast("long").alias("share"))


def _order(epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch, F.col("doc_id"), F.col("d"))


def _with_tokens(docs: DataFrame, domain: Column) -> DataFrame:
    return docs.select(F.struct("*").alias("row")).select(
        "row", F.struct(domain.alias("domain"), F.col("row.lang").alias("lang"), F.col("row.source").alias("source"))
        .alias("leaf"), F.size(words(F.col("row.text"))).cast("long").alias("n"), F.xxhash64("row.text").alias("d"))


def cuts(rows: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS,
         weights: dict = WEIGHTS, seed: int = SEED) -> DataFrame:
    """One row per leaf: its share, whole epochs, and where the last epoch is cut.

    ``rows`` is a stored table of leaf, n (tokens), doc_id and d (digest of the text).  Rows that are equal in all of
    them meet the cut together: ``part`` is what they give in all.
    """
    leaves = write_and_read(rows.groupBy("leaf").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows")), "leaves")
    total, count = leaves.agg(F.sum("tokens"), F.sum("rows")).first()
    buckets = 1 << max(0, ((count or 0) // ROWS_PER_BUCKET).bit_length())
    shared = budgets(leaves.select("leaf.*", "tokens"), F.lit((total or 0) * budget_percent // 100), max_epochs, weights)
    plan = write_and_read(shared.select(
        F.struct(*LEVELS).alias("leaf"), "tokens", "share",
        F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(0).alias("epochs"),
        F.when(F.col("tokens") > 0, F.expr("share % tokens")).otherwise(0).alias("rest")), "plan")
    ordered = rows.join(plan.filter("rest > 0"), "leaf").select(
        "leaf", "n", "rest", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "d",
        _order(F.col("epochs"), seed).alias("key")).withColumn(
        "bucket", F.shiftright("key", 64 - max(1, buckets.bit_length() - 1)))
    sums = ordered.groupBy("leaf", "bucket", "rest").agg(F.sum("n").alias("b")).selectExpr(
        "leaf", "bucket", "rest", "b", "sum(b) OVER (PARTITION BY leaf ORDER BY bucket) - b AS before")
    cut_bucket = sums.filter("before < rest AND before + b >= rest").select("leaf", "bucket", "before")
    near = ordered.join(cut_bucket, ["leaf", "bucket"])
    alike = near.groupBy("leaf", "bucket", "rest", "before", "key", "doc_id", "d", "n").agg(F.count("*").alias("c"))
    inside = alike.selectExpr("*", "before + sum(n * c) OVER (PARTITION BY leaf, bucket ORDER BY key, doc_id, d, n"
                              " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto")
    last = inside.filter("upto - n * c < rest AND upto >= rest").select(
        "leaf", F.struct("key", "doc_id", "d", "n").alias("cut"), "c",
        (F.col("rest") - F.col("upto") + F.col("n") * F.col("c")).alias("part"))
    return write_and_read(plan.join(last, "leaf", "left").select(
        F.to_json("leaf").alias("leaf_key"), "share", "epochs", "cut", "c", "part"), "cuts")


def _taken(rows: DataFrame, cut: DataFrame, seed: int) -> DataFrame:
    """Adds ``epochs`` (whole ones) and ``part`` (tokens of the last), by comparing each row with its leaf's cut."""
    at = F.struct(_order(F.col("epochs"), seed).alias("key"), F.coalesce("doc_id", F.lit(-1)).alias("doc_id"),
                  F.col("d").alias("d"), F.col("n").alias("n"))
    found = rows.withColumn("leaf_key", F.to_json("leaf")).join(cut.withColumnRenamed("part", "cut_part"), "leaf_key"
                                                                ).withColumn("at", at)
    part = F.when(F.col("at") < F.col("cut"), F.col("n")).when(F.col("at") == F.col("cut"), F.col("cut_part")).otherwise(0)
    gone = ["at", "cut", "c", "cut_part", "leaf_key"]
    if not cut.filter("c > 1").head(1):
        return found.withColumn("part", part).drop(*gone)
    # Equal rows at a cut: the first ones whole, one in part, the rest not.
    tied = F.coalesce((F.col("c") > 1) & (F.col("at") == F.col("cut")), F.lit(False))
    before = (F.row_number().over(Window.partitionBy("leaf_key").orderBy("n")) - 1) * F.col("n")
    shared = found.filter(tied).withColumn("part", F.greatest(F.lit(0), F.least(F.col("n"), F.col("cut_part") - before)))
    return found.filter(~tied).withColumn("part", part).unionByName(shared).drop(*gone)


def mix(docs: DataFrame, domain: Column | None = None, budget_percent: int = BUDGET_PERCENT,
        max_epochs: int = MAX_EPOCHS, weights: dict = WEIGHTS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, domain, lang, source, n_tokens, full_epochs, last_tokens, taken_tokens."""
    domain = domain_of(F.col("row.source")) if domain is None else domain
    rows = write_and_read(_with_tokens(docs, domain).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "leaf", "n", "d"), "tokens")
    taken = _taken(rows, cuts(rows, budget_percent, max_epochs, weights, seed), seed)
    return taken.select("doc_id", "leaf.domain", "leaf.lang", "leaf.source", F.col("n").alias("n_tokens"),
                        F.col("epochs").cast("long").alias("full_epochs"), F.col("part").cast("long").alias("last_tokens"),
                        (F.col("epochs") * F.col("n") + F.col("part")).cast("long").alias("taken_tokens"))


def mixed(docs: DataFrame, domain: Column | None = None, budget_percent: int = BUDGET_PERCENT,
          max_epochs: int = MAX_EPOCHS, weights: dict = WEIGHTS, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them: a row for each epoch, the last one cut to its tokens."""
    domain = domain_of(F.col("row.source")) if domain is None else domain
    rows = _with_tokens(docs, domain).withColumn("doc_id", F.col("row.doc_id").cast("long"))
    stored = write_and_read(rows.select("doc_id", "leaf", "n", "d"), "tokens")
    taken = _taken(rows, cuts(stored, budget_percent, max_epochs, weights, seed), seed)
    times = F.concat(F.when(F.col("epochs") > 0, F.array_repeat("n", F.col("epochs").cast("int"))).otherwise(
        F.array().cast("array<bigint>")), F.when(F.col("part") > 0, F.array("part")).otherwise(
        F.array().cast("array<bigint>")))
    each = taken.select("row", "n", F.explode(times).alias("take")).filter("take > 0")
    prefix = F.array_join(F.slice(F.regexp_extract_all(
        "row.text", F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0)), F.lit(1), F.col("take").cast("int")), "")
    own = {"text": F.when(F.col("take") < F.col("n"), prefix).otherwise(F.col("row.text")).alias("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("take") < F.col("n"), F.length(prefix).cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")).alias("n_chars")
    return each.select(*[own.get(c, F.col("row")[c].alias(c)) for c in docs.columns])
