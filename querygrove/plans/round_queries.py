"""Replay of the judge loop and its accuracy reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rounds
from ..session import fresh_path
from ..sources import records
from . import fixtures as fx
from .registry import query

REASON = """CASE WHEN error IS NOT NULL AND (round > 1 OR round > 2) THEN 'error' WHEN round > 2 THEN 'retries'
 WHEN has_sql = 0 AND error IS NULL THEN 'no sql'
 WHEN error IS NULL AND coalesce(judge_label >= 7, TRUE) THEN 'accepted' END"""
REPLAY = fx.with_views("round_texts", f"""
SELECT sample_id, round, label, judged, stop_reason FROM (
 SELECT *, coalesce(sum(CASE WHEN stop_reason IS NULL THEN 0 ELSE 1 END)
   OVER (PARTITION BY sample_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped
 FROM (SELECT *, {REASON} AS stop_reason, round <= 2 AND has_sql = 1 AND error IS NULL AS judged
  FROM round_texts WHERE round <= 3) m) w
WHERE stopped = 0""")


def _texts(spark, sf_dir):
    return fx.view(spark, sf_dir, "round_texts")


@query("ev_round_replay", REPLAY)
def round_replay(spark, sf_dir):
    return rounds.replay(_texts(spark, sf_dir)).select("sample_id", "round", "label", "judged", "stop_reason")


@query("ev_from_responses", fx.with_views("rounds", """
SELECT sample_id, round, CASE WHEN has_sql = 1 THEN 'SELECT ' || judge_label || ' AS r' || round ELSE 'none for round ' || round END AS query, has_sql,
 CASE WHEN label + judge_label <> 7 THEN 'scored ' || judge_label END AS judge_reasoning,
 CASE WHEN label + judge_label <> 7 THEN CAST(judge_label AS BIGINT) END AS judge_label FROM rounds"""))
def from_responses(spark, sf_dir):
    """Rounds read from what models and judges answered."""
    read = rounds.from_responses(fx.view(spark, sf_dir, "round_responses"))
    return read.select("sample_id", "round", "query", "has_sql", "judge_reasoning", F.col("judge_label").cast("bigint").alias("judge_label"))


@query("ev_run_manifest", """SELECT 'replay' AS run_id, '{"max_retries": 2, "samples": ' || count(DISTINCT conv_id) || ', "threshold": 7}' AS arguments,
 'policy' AS left_out FROM conversations WHERE role = 'assistant'""")
def run_manifest(spark, sf_dir):
    """How a replay over the recorded rounds was started, written beside its output and read back."""
    samples = fx.view(spark, sf_dir, "rounds").select("sample_id").distinct().count()
    manifest = records.run_manifest(spark, "replay", {"threshold": 7, "max_retries": 2, "samples": samples, "policy": rounds.replay})
    path = fresh_path(spark, "manifest")
    records.write_records(manifest, path)
    return spark.read.schema(manifest.schema).json(path).withColumn("left_out", F.array_join("left_out", ","))


@query("ev_error_rounds", fx.with_views("round_texts", """
SELECT sample_id, round, coalesce(query, before) AS query, 0 AS label, 'no answer: ' || error AS exec_err FROM (
 SELECT *, coalesce(last_value(query IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY round
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM round_texts) t
WHERE error IS NOT NULL"""))
def error_rounds(spark, sf_dir):
    return rounds.error_rounds(_texts(spark, sf_dir)).select("sample_id", "round", "query", "label", "exec_err")


@query("ev_feedback_hint", fx.with_views("round_texts", """
SELECT sample_id, round, CASE WHEN round = 1 THEN 'in lines' ELSE 'in lines' || chr(10) || chr(10) || 'Previous attempt: '
 || coalesce(lag(query) OVER w, '') || chr(10) || chr(10) || 'Feedback: ' || coalesce(lag(judge_reasoning) OVER w, '') END AS hint
FROM round_texts WINDOW w AS (PARTITION BY sample_id ORDER BY round)"""))
def feedback_hint(spark, sf_dir):
    rows = _texts(spark, sf_dir).withColumn("evidence", F.lit("in lines"))
    return rounds.feedback_hints(rows).select("sample_id", "round", "hint")


@query("ev_last_round", fx.with_views("rounds", """
SELECT sample_id, round, judge_label, label FROM (
 SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round DESC) AS rn FROM rounds) t WHERE rn = 1"""))
def last_round(spark, sf_dir):
    return rounds.last_round(fx.view(spark, sf_dir, "rounds")).select("sample_id", "round", "judge_label", "label")


@query("ev_accuracy", f"""
SELECT sample_id, round(avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END), 6) AS acc, count(*) AS n_samples,
 CAST(grouping(sample_id) AS INT) AS is_overall
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round DESC) AS rn FROM ({REPLAY}) k) t WHERE rn = 1) l
GROUP BY GROUPING SETS ((sample_id), ())""")
def accuracy(spark, sf_dir):
    report = rounds.accuracy(rounds.replay(_texts(spark, sf_dir)))
    return report.withColumn("acc", F.round("acc", 6))


@query("ev_by_round", f"""
SELECT round, stop_reason, count(*) AS n_rounds, CAST(sum(label) AS BIGINT) AS n_correct,
 round(avg(CAST(label AS DOUBLE)), 6) AS accuracy FROM ({REPLAY}) k GROUP BY round, stop_reason""")
def by_round(spark, sf_dir):
    kept = rounds.replay(_texts(spark, sf_dir))
    return rounds.accuracy_by(kept, "round", "stop_reason").withColumn("accuracy", F.round("accuracy", 6))


@query("ev_by_judge_label", fx.with_views("rounds", """
SELECT judge_label, count(*) AS n_rounds, CAST(sum(label) AS BIGINT) AS n_correct,
 round(avg(CAST(label AS DOUBLE)), 6) AS accuracy FROM rounds GROUP BY judge_label"""))
def by_judge_label(spark, sf_dir):
    report = rounds.accuracy_by(fx.view(spark, sf_dir, "rounds"), "judge_label")
    return report.withColumn("accuracy", F.round("accuracy", 6))


@query("ev_report", fx.with_views("round_texts", """
SELECT CASE WHEN g = 1 THEN 'overall' ELSE db_id END AS db_id, CASE WHEN g = 1 THEN 'Overall accuracy' ELSE question END AS question,
 CASE WHEN g = 1 THEN '' ELSE gold_query END AS gold_query, CASE WHEN g = 1 THEN '' ELSE predicted_query END AS predicted_query, round(acc, 6) AS acc
FROM (SELECT db_id, question, gold_query, predicted_query, avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS acc, grouping(db_id) AS g
 FROM (SELECT 'db' AS db_id, 'Question ' || sample_id AS question, 'SELECT ' || sample_id AS gold_query, query AS predicted_query, label,
   row_number() OVER (PARTITION BY sample_id ORDER BY round DESC) AS rn FROM round_texts) l
 WHERE rn = 1 GROUP BY GROUPING SETS ((db_id, question, gold_query, predicted_query), ())) r"""))
def report(spark, sf_dir):
    name = F.col("sample_id").cast("string")
    rows = _texts(spark, sf_dir).select(
        F.lit("db").alias("db_id"), F.concat(F.lit("Question "), name).alias("question"),
        F.concat(F.lit("SELECT "), name).alias("gold_query"), "round", "query", "label")
    return rounds.accuracy_report(rows).withColumn("acc", F.round("acc", 6))
