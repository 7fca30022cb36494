"""The generate-judge-fix loop replayed over recorded rounds.

Under a policy a sample has at most ``max_retries + 1`` rounds: :func:`replay`
drops rows beyond that before any window.  The other operators keep every
recorded round, so their windows are as long as a sample's record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rewards import judge_label, judge_reasoning
from ..functions.sqltext import extract_sql, has_sql_fence

# The row of a report that stands for all questions.
OVERALL = {"db_id": "overall", "question": "Overall accuracy", "gold_query": "", "predicted_query": ""}
# The text put between the parts of a feedback hint.
FEEDBACK_PARTS = ("\n\nPrevious attempt: ", "\n\nFeedback: ")


def _in_order(*extra):
    return Window.partitionBy("sample_id").orderBy("round")


def from_responses(responses: DataFrame) -> DataFrame:
    """Rounds from recorded texts: adds the query, whether the response holds
    SQL, and the judge's reasoning and label.

    ``model_response`` and ``judge_response`` are read; the latter may be null.
    """
    return (responses.withColumn("query", extract_sql(F.col("model_response")))
            .withColumn("has_sql", has_sql_fence(F.col("model_response")).cast("int"))
            .withColumn("judge_reasoning", judge_reasoning(F.col("judge_response")))
            .withColumn("judge_label", judge_label(F.col("judge_response"))))


def replay(rounds: DataFrame, max_retries: int = 2, threshold: float = 7) -> DataFrame:
    """The rounds the policy would have kept, and why the last one was last.

    A round is judged only if another may follow it.  A label that is not a
    number counts as good enough.  A model failure ends the loop unless it
    happens in the first round.
    """
    has_error = F.col("error").isNotNull() if "error" in rounds.columns else F.lit(False)
    last_allowed = F.col("round") > max_retries
    no_sql = (F.col("has_sql") == 0) & ~has_error
    judged = ~last_allowed & ~no_sql & ~has_error
    passed = judged & ~F.coalesce(F.col("judge_label") < threshold, F.lit(False))
    reason = (F.when(has_error & ((F.col("round") > 1) | last_allowed), F.lit("error"))
              .when(last_allowed, F.lit("retries")).when(no_sql, F.lit("no sql"))
              .when(passed, F.lit("accepted")))
    marked = (rounds.filter(F.col("round") <= max_retries + 1)
              .withColumn("judged", judged).withColumn("stop_reason", reason))
    stopped = F.sum(F.when(F.col("stop_reason").isNotNull(), 1).otherwise(0)).over(
        _in_order().rowsBetween(Window.unboundedPreceding, -1))
    return (marked.withColumn("_stopped", F.coalesce(stopped, F.lit(0)))
            .filter(F.col("_stopped") == 0).drop("_stopped"))


def error_rounds(rounds: DataFrame) -> DataFrame:
    """One row per failed round: the query before it, label 0 and the message."""
    before = F.last("query", ignorenulls=True).over(
        _in_order().rowsBetween(Window.unboundedPreceding, -1))
    return (rounds.withColumn("query", F.coalesce("query", before, F.lit("")))
            .filter(F.col("error").isNotNull())
            .withColumn("exec_res", F.lit(0))
            .withColumn("exec_err", F.concat(F.lit("no answer: "), F.col("error")))
            .withColumn("label", F.lit(0)))


def feedback_hints(rounds: DataFrame, evidence: str = "evidence") -> DataFrame:
    """The hint of each later round: evidence, the last attempt, its judgement."""
    back = {c: F.lag(c).over(_in_order()) for c in ("query", "judge_reasoning")}
    hint = F.concat(F.coalesce(F.col(evidence), F.lit("")),
                    F.lit(FEEDBACK_PARTS[0]), F.coalesce(F.col("_query"), F.lit("")),
                    F.lit(FEEDBACK_PARTS[1]), F.coalesce(F.col("_reasoning"), F.lit("")))
    return (rounds.withColumn("_query", back["query"]).withColumn("_reasoning", back["judge_reasoning"])
            .withColumn("hint", F.when(F.col("round") == 1, F.col(evidence)).otherwise(hint))
            .drop("_query", "_reasoning"))


def last_round(rounds: DataFrame, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """The last recorded round of each sample, by partial aggregation."""
    rest = [c for c in rounds.columns if c not in keys]
    return (rounds.groupBy(*keys).agg(F.max_by(F.struct(*rest), "round").alias("_last"))
            .select(*keys, *[F.col(f"_last.`{c}`").alias(c) for c in rest]))


def accuracy(rounds: DataFrame, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Share of samples whose last round is right: one row each and one overall.

    The overall row has null keys and ``is_overall`` 1.  Without samples the
    overall accuracy is null.
    """
    last = last_round(rounds, keys)
    right = F.avg((F.col("label") == 1).cast("double"))
    sets = [[F.col(k) for k in keys], []]
    return (last.groupingSets(sets, *keys)
            .agg(right.alias("acc"), F.count(F.lit(1)).alias("n_samples"),
                 F.grouping(keys[0]).cast("int").alias("is_overall")))


def accuracy_report(rounds: DataFrame) -> DataFrame:
    """``db_id, question, gold_query, predicted_query, acc``: the last round of
    each question, and one row for all of them."""
    last = (last_round(rounds, ("db_id", "question", "gold_query"))
            .withColumnRenamed("query", "predicted_query"))
    names = list(OVERALL)
    report = last.groupingSets([[F.col(n) for n in names], []], *names).agg(
        F.avg((F.col("label") == 1).cast("double")).alias("acc"), F.grouping("db_id").alias("_all"))
    return report.select(*[F.when(F.col("_all") == 1, F.lit(text)).otherwise(F.col(n)).alias(n)
                           for n, text in OVERALL.items()], "acc")


def accuracy_by(rounds: DataFrame, *columns: str) -> DataFrame:
    """Tally of right and wrong rounds by round number, judge label or both."""
    return rounds.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("n_rounds"),
        F.sum("label").cast("bigint").alias("n_correct"),
        F.avg(F.col("label").cast("double")).alias("accuracy"))
