"""Parsing of judge responses and their rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rewards
from . import fixtures as fx
from . import oracle_text as duck
from .registry import query

DIGITS = rf"regexp_extract(response, '<label>{duck.BLANK}*(\p{{Nd}}+){duck.BLANK}*</label>', 1)"
LABEL = f"CASE WHEN {DIGITS} = '' THEN -1 ELSE coalesce(TRY_CAST({DIGITS} AS BIGINT), 9223372036854775807) END"
ACCURACY = (f"CASE WHEN {LABEL} = -1 THEN -1.0 ELSE "
            f"round(2 * exp(-0.5 * abs(CAST(answer AS DOUBLE) - CAST({LABEL} AS DOUBLE))), 9) END")


def _once(tag: str) -> str:
    size = len(tag.encode("ascii").replace(b"\n", b"x"))
    text = "'" + tag.replace("\n", "' || chr(10) || '") + "'"
    return (f"CASE WHEN (length(response) - length(replace(response, {text}, ''))) // {size} = 1 "
            "THEN 0.125 ELSE 0.0 END")


TAGS = " + ".join(_once(t) for t in rewards.COUNTED_TAGS) + f" - CASE WHEN {LABEL} = -1 THEN 0.5 ELSE 0.0 END"
FORMAT = rf"<reasoning>.*?</reasoning>{duck.BLANK}*<label>.*?</label>"


def _responses(spark, sf_dir):
    return fx.view(spark, sf_dir, "responses")


@query("rw_parse_judge", fx.with_views("responses", f"""
SELECT resp_id, reasoning, label_text,
 CASE WHEN regexp_matches(label_text, '^[+-]?[0-9]+$') THEN TRY_CAST(label_text AS BIGINT) END AS label
FROM (SELECT resp_id, {duck.strip_text("regexp_extract(response, '(?s)<reasoning>(.*?)</reasoning>', 1)")} AS reasoning,
 {duck.strip_text("regexp_extract(response, '(?s)<label>(.*?)</label>', 1)")} AS label_text FROM responses) t"""))
def parse_judge(spark, sf_dir):
    response = F.col("response")
    return _responses(spark, sf_dir).select(
        "resp_id", rewards.judge_reasoning(response).alias("reasoning"),
        rewards.judge_label_text(response).alias("label_text"), rewards.judge_label(response).alias("label"))


@query("rw_label", fx.with_views("responses", f"SELECT resp_id, {LABEL} AS label FROM responses"))
def label(spark, sf_dir):
    return _responses(spark, sf_dir).select("resp_id", rewards.label(F.col("response")).alias("label"))


@query("rw_accuracy", fx.with_views("responses", f"SELECT resp_id, CAST({ACCURACY} AS DOUBLE) AS accuracy_reward FROM responses"))
def accuracy(spark, sf_dir):
    reward = rewards.accuracy_reward(F.col("response"), F.col("answer"))
    return _responses(spark, sf_dir).select("resp_id", F.round(reward, 9).alias("accuracy_reward"))


@query("rw_strict", fx.with_views("responses", f"""
SELECT resp_id, CASE WHEN regexp_matches(response, '(?s)^{duck.BLANK}*{FORMAT}{duck.BLANK}*$')
 THEN CAST(0.5 AS DOUBLE) ELSE 0.0 END AS strict_reward FROM responses"""))
def strict(spark, sf_dir):
    return _responses(spark, sf_dir).select(
        "resp_id", rewards.strict_format_reward(F.col("response")).alias("strict_reward"))


@query("rw_soft", fx.with_views("responses", f"""
SELECT resp_id, CASE WHEN regexp_matches(response, '(?s){FORMAT}') THEN CAST(0.5 AS DOUBLE) ELSE 0.0 END AS soft_reward
FROM responses"""))
def soft(spark, sf_dir):
    return _responses(spark, sf_dir).select(
        "resp_id", rewards.soft_format_reward(F.col("response")).alias("soft_reward"))


@query("rw_xmlcount", fx.with_views("responses", f"SELECT resp_id, CAST({TAGS} AS DOUBLE) AS tag_reward FROM responses"))
def xmlcount(spark, sf_dir):
    return _responses(spark, sf_dir).select("resp_id", rewards.tag_reward(F.col("response")).alias("tag_reward"))


@query("rw_total", fx.with_views("responses", f"""
SELECT answer, count(*) AS n_responses, round(avg(CAST({ACCURACY} AS DOUBLE)), 6) AS mean_accuracy,
 round(avg(CAST({TAGS} AS DOUBLE)), 6) AS mean_tags, round(avg(CAST({ACCURACY} AS DOUBLE) + CAST({TAGS} AS DOUBLE)), 6) AS mean_total
FROM responses GROUP BY answer"""))
def total(spark, sf_dir):
    accuracy_part = F.round(rewards.accuracy_reward(F.col("response"), F.col("answer")), 9)
    scored = _responses(spark, sf_dir).select(
        "answer", accuracy_part.alias("a"), rewards.tag_reward(F.col("response")).alias("t"))
    return scored.groupBy("answer").agg(
        F.count(F.lit(1)).alias("n_responses"), F.round(F.avg("a"), 6).alias("mean_accuracy"),
        F.round(F.avg("t"), 6).alias("mean_tags"), F.round(F.avg(F.col("a") + F.col("t")), 6).alias("mean_total"))
