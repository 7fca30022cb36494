"""Curation: extraction, normalisation, deduplication, consolidation, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqltext
from ..operators import curation
from . import fixtures as fx
from . import oracle_text as duck
from .registry import query

EXTRACT = duck.extracted("model_answer")
# A candidate with quotes of all kinds, for the cleaning step.
QUOTED = ("replace(replace(generated_query, 'p_name', chr(34) || 'p_name' || chr(34)), "
          "chr(39), chr(92) || chr(39)) || ' -- it' || chr(39) || 's' || chr(10) || ' LIMIT 3'")


@query("cur_extract_sql", fx.with_views(
    "answers", f"SELECT cand_id, {EXTRACT} AS extracted_sql FROM answers"))
def extract_sql(spark, sf_dir):
    return fx.view(spark, sf_dir, "answers").select(
        "cand_id", sqltext.extract_sql(F.col("model_answer")).alias("extracted_sql"))


@query("cur_dedup_ws", fx.with_views("answers", f"""
SELECT source_model, question, generated_query, min(cand_id) AS cand_id
FROM (SELECT source_model, question, cand_id, {duck.collapse(EXTRACT)} AS generated_query FROM answers) t
GROUP BY source_model, question, generated_query"""))
def dedup_ws(spark, sf_dir):
    rows = fx.view(spark, sf_dir, "answers").withColumn(
        "generated_query", sqltext.extract_sql(F.col("model_answer")))
    rows = rows.select("source_model", "question", "cand_id", "generated_query", "model_answer")
    kept = curation.dedup_answers(rows, ["source_model", "question"], ["cand_id"])
    return kept.select("source_model", "question", "generated_query", "cand_id")


@query("cur_clean_sql", fx.with_views(
    "candidates", f"SELECT cand_id, {duck.cleaned(QUOTED)} AS clean_sql FROM candidates"))
def clean_sql(spark, sf_dir):
    rows = fx.sql(spark, sf_dir, "candidates", f"SELECT cand_id, {QUOTED} AS quoted FROM candidates")
    return rows.select("cand_id", sqltext.clean_sql(F.col("quoted")).alias("clean_sql"))


@query("cur_normalize_sql", fx.with_views("candidates", f"""
SELECT cand_id, {duck.normalized('generated_query')} AS norm_sql,
 {duck.normalized('generated_query', '[ ;]+$')} AS tight_sql FROM candidates"""))
def normalize_sql(spark, sf_dir):
    query_text = F.col("generated_query")
    return fx.view(spark, sf_dir, "candidates").select(
        "cand_id", sqltext.normalize_sql(query_text).alias("norm_sql"),
        sqltext.normalize_sql(query_text, trim_tail=True).alias("tight_sql"))


DEDUP = fx.with_views("candidates", f"""
SELECT db_id, question, cand_id, source_model, generated_query, norm_sql, label FROM (
 SELECT *, row_number() OVER (PARTITION BY db_id, question, norm_sql ORDER BY source_model, cand_id) AS rn
 FROM (SELECT *, {duck.normalized('generated_query')} AS norm_sql FROM candidates) n) r
WHERE rn = 1""")


def deduplicated(spark, sf_dir):
    return curation.dedup_candidates(
        fx.view(spark, sf_dir, "candidates"), ["db_id", "question"], ["source_model", "cand_id"])


@query("cur_dedup_norm", DEDUP)
def dedup_norm(spark, sf_dir):
    return deduplicated(spark, sf_dir).select(
        "db_id", "question", "cand_id", "source_model", "generated_query", "norm_sql", "label")


@query("cur_antijoin", fx.with_views("candidates filter_list", """
SELECT cand_id, question FROM candidates WHERE question NOT IN
 (SELECT question FROM filter_list WHERE overall_confidence = 10)"""))
def antijoin(spark, sf_dir):
    rows = fx.view(spark, sf_dir, "candidates").select("cand_id", "question")
    return curation.drop_listed(rows, fx.view(spark, sf_dir, "filter_list"))


@query("cur_consolidate", fx.with_views("candidates", """
SELECT c.cand_id, c.db_id, c.question, c.generated_query, c.source_model, c.label, h.gold_query, h.evidence, h.n_answers
FROM candidates c JOIN (SELECT db_id, question, arg_min(gold_query, cand_id) AS gold_query,
  arg_min(evidence, cand_id) AS evidence, count(*) AS n_answers
 FROM candidates GROUP BY db_id, question) h
ON c.db_id = h.db_id AND c.question = h.question"""))
def consolidate(spark, sf_dir):
    rows = fx.view(spark, sf_dir, "candidates").select(
        "cand_id", "db_id", "question", "generated_query", "source_model", "label", "gold_query", "evidence")
    keys = ["db_id", "question"]
    flat = curation.consolidate(rows, keys, ["cand_id"])
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_answers"))
    return curation.salted_lookup(flat, counts, keys, "inner")


@query("cur_question_summary", fx.with_views("candidates", """
SELECT db_id, question, arg_min(gold_query, source_model || lpad(CAST(cand_id AS STRING), 12, '0')) AS gold_query,
 arg_min(evidence, source_model || lpad(CAST(cand_id AS STRING), 12, '0')) AS evidence,
 count(*) AS n_answers, CAST(sum(label) AS BIGINT) AS n_correct, count(DISTINCT source_model) AS n_models
FROM candidates GROUP BY db_id, question"""))
def question_summary(spark, sf_dir):
    return curation.question_summary(fx.view(spark, sf_dir, "candidates"),
                                     ["db_id", "question"], ["source_model", "cand_id"])


@query("cur_explode", fx.with_views("result_rows", """
SELECT task, source_model, position, generated_query, model_answer, label FROM (
 SELECT *, count(*) OVER (PARTITION BY task, source_model) AS n FROM result_rows) t
WHERE position < CASE WHEN source_model = 'm0' AND n > 1 THEN n - 1 ELSE n END"""))
def explode(spark, sf_dir):
    lists = result_lists(fx.view(spark, sf_dir, "result_rows"), ["task", "source_model"])
    # One model lost its last label, so its last answer has to go too.
    short = F.when((F.col("source_model") == "m0") & (F.size("labels") > 1),
                   F.slice("labels", F.lit(1), F.size("labels") - 1)).otherwise(F.col("labels"))
    return curation.explode_results(
        lists.withColumn("labels", short),
        {"answers": "model_answer", "generated_queries": "generated_query", "labels": "label"})


def result_lists(rows, keys):
    """The record form of a result file: one row per task, with parallel lists."""
    ordered = F.array_sort(F.collect_list(F.struct(
        "position", "model_answer", "generated_query", "label")))
    packed = rows.groupBy(*keys).agg(ordered.alias("_rows"))
    return packed.select(
        *keys, F.col("_rows.model_answer").alias("answers"),
        F.col("_rows.generated_query").alias("generated_queries"),
        F.col("_rows.label").alias("labels"))


@query("cur_string_cluster", fx.with_views("candidates", f"""
SELECT db_id, question, {duck.cleaned('generated_query')} AS clean_sql,
 arg_min(generated_query, cand_id) AS first_query, count(*) AS n_queries
FROM candidates GROUP BY 1, 2, 3"""))
def string_cluster(spark, sf_dir):
    return curation.string_clusters(fx.view(spark, sf_dir, "candidates"), ["db_id", "question"], ["cand_id"])


@query("cur_count_by_model", f"SELECT source_model, count(*) AS n_rows FROM ({DEDUP}) d GROUP BY source_model")
def count_by_model(spark, sf_dir):
    return curation.count_by(deduplicated(spark, sf_dir), "source_model")


@query("cur_count_by_label", f"SELECT label, count(*) AS n_rows FROM ({DEDUP}) d GROUP BY label")
def count_by_label(spark, sf_dir):
    return curation.count_by(deduplicated(spark, sf_dir), "label")
