"""Labels, syntax checks and previews of recorded SQL run on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import execution
from ..operators.scoring import distinct_queries
from . import fixtures as fx
from . import generation
from . import oracle_text as duck
from .registry import query

# Pairs of gold and candidate SQL that plan, with what decides their label.
PAIRS = {
    "same": ("SELECT p_name FROM part WHERE p_size > 10", "SELECT p_name AS z FROM part WHERE NOT p_size <= 10 ORDER BY 1"),
    "duplicates": ("SELECT DISTINCT p_brand FROM part", "SELECT p_brand FROM part"),
    "int and double": ("SELECT p_size FROM part", "SELECT CAST(p_size AS DOUBLE) FROM part"),
    "columns swapped": ("SELECT p_name, p_brand FROM part", "SELECT p_brand, p_name FROM part"),
    "both empty": ("SELECT p_name FROM part WHERE p_size < 0", "SELECT p_name FROM part WHERE p_size < -1"),
    "null rows": ("SELECT nullif(p_size, p_size) AS a FROM part", "SELECT nullif(p_size, p_size) AS b FROM part"),
    "other bound": ("SELECT p_partkey FROM part WHERE p_size > 10", "SELECT p_partkey FROM part WHERE p_size >= 10"),
    "subset": ("SELECT o_custkey FROM orders", "SELECT c_custkey FROM customer"),
    "grouped": ("SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey",
                "SELECT o_custkey, CAST(sum(1) AS BIGINT) FROM orders GROUP BY 1"),
}
# DuckDB compares text and number after a cast; they are different here.
TEXT_AND_NUMBER = ("SELECT p_size FROM part", "SELECT CAST(p_size AS STRING) FROM part")


def _duck_pair(name: str, gold: str, other: str) -> str:
    return f"""SELECT '{name}' AS pair, CASE WHEN NOT EXISTS ({gold} EXCEPT ({other})) AND NOT EXISTS (({other}) EXCEPT {gold})
 AND EXISTS ({gold}) THEN 1 ELSE 0 END AS exec_res"""


@query("ex_set_equal", " UNION ALL ".join(_duck_pair(n, *p) for n, p in PAIRS.items())
       + " UNION ALL SELECT 'text and number' AS pair, 0 AS exec_res")
def set_equal(spark, sf_dir):
    return _compare(spark, sf_dir, execution.set_equal)


@query("ex_set_equal_except", " UNION ALL ".join(_duck_pair(n, *p) for n, p in PAIRS.items())
       + " UNION ALL SELECT 'text and number' AS pair, 0 AS exec_res")
def set_equal_except(spark, sf_dir):
    return _compare(spark, sf_dir, execution.set_equal_by_except)


def _compare(spark, sf_dir, equal):
    frames = []
    for name, (gold, other) in {**PAIRS, "text and number": TEXT_AND_NUMBER}.items():
        left, right = fx.sql(spark, sf_dir, "", gold), fx.sql(spark, sf_dir, "", other)
        frames.append(equal(left, right).select(F.lit(name).alias("pair"), "exec_res"))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _tables(sf_dir):
    def read(session, db_id):
        return {t: fx.table(session, sf_dir, t) for t in ("part", "supplier")}
    return read


def _candidates(spark, sf_dir):
    """The candidates, all over one database that holds part and supplier."""
    return fx.view(spark, sf_dir, "candidates").withColumn("db_id", F.lit("shop"))


def _texts(rows):
    return distinct_queries(rows).unionByName(distinct_queries(rows, "gold_query")).distinct()


@query("ex_run", fx.with_views("candidates", """
SELECT DISTINCT 'shop' AS db_id, query, CASE WHEN kind = 4 THEN 2 WHEN kind <> 6 THEN 1 END AS n_columns,
 CASE kind WHEN 3 THEN (SELECT count(DISTINCT p_name) FROM part WHERE p_size >= k) WHEN 4 THEN (SELECT count(DISTINCT p_brand) FROM part)
  WHEN 5 THEN n_names WHEN 6 THEN NULL WHEN 7 THEN (SELECT count(DISTINCT s_name) FROM supplier) ELSE (SELECT count(DISTINCT p_name) FROM part WHERE p_size > k) END AS n_distinct,
 CASE kind WHEN 3 THEN (SELECT count(*) FROM part WHERE p_size >= k) WHEN 4 THEN (SELECT count(DISTINCT p_brand) FROM part)
  WHEN 5 THEN n_rows WHEN 7 THEN (SELECT count(*) FROM supplier) WHEN 6 THEN NULL ELSE (SELECT count(*) FROM part WHERE p_size > k) END AS n_rows
FROM (SELECT generated_query AS query, cand_id % 8 AS kind, question_id % 50 AS k, b.n_names, b.n_rows FROM candidates c JOIN part p ON p.p_partkey = c.cand_id
 JOIN (SELECT p_brand, count(DISTINCT p_name) AS n_names, count(*) AS n_rows FROM part GROUP BY p_brand) b ON b.p_brand = p.p_brand) q"""))
def run(spark, sf_dir):
    """Columns, rows and distinct rows of every distinct candidate text; nulls where it failed."""
    found = execution.run_queries(spark, distinct_queries(_candidates(spark, sf_dir)), _tables(sf_dir), with_preview=True)
    n_rows = F.regexp_extract("preview", "^Rows: ([0-9]+)", 1)
    return found.select("db_id", "query", "n_columns", "n_distinct", F.when(n_rows != "", n_rows).cast("bigint").alias("n_rows"))


@query("ex_syntax", fx.with_views("candidates", """
SELECT DISTINCT 'shop' AS db_id, generated_query AS query, CASE WHEN generated_query LIKE 'SELEC %' THEN CAST(0 AS DOUBLE) ELSE 1.0 END AS syntax_check
FROM candidates"""))
def syntax(spark, sf_dir):
    checks = execution.syntax_checks(spark, distinct_queries(_candidates(spark, sf_dir)), _tables(sf_dir))
    return checks.select("db_id", "query", "syntax_check")


LABELS = """
SELECT cand_id, exec_res, CASE WHEN kind = 6 THEN 'error' WHEN exec_res = 1 THEN '--' ELSE 'incorrect answer' END AS status
FROM (SELECT cand_id, kind, CASE WHEN kind < 6 AND kind <> 4 AND len(gold) > 0 AND found = gold THEN 1 ELSE 0 END AS exec_res
 FROM (SELECT cand_id, cand_id % 8 AS kind, g.names AS gold,
  CASE cand_id % 8 WHEN 3 THEN e.names WHEN 5 THEN b.names ELSE g.names END AS found
  FROM candidates c JOIN part p ON p.p_partkey = c.cand_id
  JOIN (SELECT k, (SELECT list(DISTINCT p_name ORDER BY p_name) FROM part WHERE p_size > k) AS names FROM range(0, 50) r(k)) g ON g.k = c.question_id % 50
  JOIN (SELECT k, (SELECT list(DISTINCT p_name ORDER BY p_name) FROM part WHERE p_size >= k) AS names FROM range(0, 50) r(k)) e ON e.k = c.question_id % 50
  JOIN (SELECT p_brand, list(DISTINCT p_name ORDER BY p_name) AS names FROM part GROUP BY p_brand) b ON b.p_brand = p.p_brand) x) y"""


@query("ex_labels", fx.with_views("candidates", LABELS))
def labels(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    results = execution.run_queries(spark, _texts(rows), _tables(sf_dir))
    status = F.when(F.col("exec_err").isin(execution.RIGHT, execution.WRONG), F.col("exec_err")).otherwise(F.lit("error"))
    return execution.labelled(rows, results).select("cand_id", "exec_res", status.alias("status"))


@query("ex_labelled_answers", fx.with_views("answers", f"""
SELECT a.cand_id, a.generated_query, CASE WHEN a.cand_id % 5 = 2 THEN 0 ELSE l.exec_res END AS label FROM (SELECT min(cand_id) AS cand_id, generated_query
 FROM (SELECT source_model, question, cand_id, {duck.collapse(duck.extracted("model_answer"))} AS generated_query FROM answers) t
 GROUP BY source_model, question, generated_query) a JOIN ({LABELS}) l ON l.cand_id = a.cand_id"""))
def labelled_answers(spark, sf_dir):
    """From recorded model answers to labelled candidates: extract, drop repeats, run, compare with the gold query.

    Answers whose fence has an upper-case tag are not extracted, and no query.
    """
    rows = fx.view(spark, sf_dir, "answers").withColumn("db_id", F.lit("shop"))
    found = generation.labelled_answers(spark, rows, _tables(sf_dir), order=("cand_id",))
    return found.select("cand_id", "generated_query", "label")


PREVIEWED = {
    "first orders": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderkey",
    "few parts": "SELECT p_name, nullif(p_size, 50) AS s FROM part WHERE p_size > 49 ORDER BY p_partkey",
    "none": "SELECT p_name FROM part WHERE p_size < 0 ORDER BY p_name",
}


def _duck_preview(name: str, sql: str, cells: str, columns: int) -> str:
    return f"""SELECT '{name}' AS shown, left('Rows: ' || count(*) || ', Columns: ' || CASE WHEN count(*) > 0 THEN {columns} ELSE 0 END || ', Results: ['
 || coalesce(array_to_string(list('[' || {cells} || ']')[1:20], ', '), '') || ']', 2000) AS preview FROM ({sql}) t"""


@query("ex_preview", " UNION ALL ".join([
    _duck_preview("first orders", PREVIEWED["first orders"],
                  "o_orderkey || ', \"' || o_orderpriority || '\", ' || o_totalprice", 3),
    _duck_preview("few parts", PREVIEWED["few parts"], "'\"' || p_name || '\", ' || coalesce(CAST(s AS VARCHAR), 'null')", 2),
    _duck_preview("none", PREVIEWED["none"], "p_name", 1)]))
def previews(spark, sf_dir):
    frames = [execution.preview(fx.sql(spark, sf_dir, "", text)).select(F.lit(name).alias("shown"), "preview")
              for name, text in PREVIEWED.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
