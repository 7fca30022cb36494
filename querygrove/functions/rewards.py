"""Parsing of judge responses and the reward of a response, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANK, count_literal, strip

# The response format and the weights of its parts.
REASONING = r"(?s)<reasoning>(.*?)</reasoning>"
LABEL_TEXT = r"(?s)<label>(.*?)</label>"
LABEL_DIGITS = rf"<label>{BLANK}*(\p{{Nd}}+){BLANK}*</label>"
WHOLE_FORMAT = rf"(?s)<reasoning>.*?</reasoning>{BLANK}*<label>.*?</label>"
COUNTED_TAGS = ["<reasoning>\n", "\n</reasoning>\n", "\n<label>\n", "\n</label>"]
TAG_WEIGHT = 0.125
NO_LABEL_PENALTY = 0.5
FORMAT_REWARD = 0.5
MISSING = -1


def judge_reasoning(response: Column) -> Column:
    return strip(F.regexp_extract(response, REASONING, 1))


def judge_label_text(response: Column) -> Column:
    return strip(F.regexp_extract(response, LABEL_TEXT, 1))


def judge_label(response: Column) -> Column:
    """The label as a number, or null when it is not a whole number."""
    text = judge_label_text(response)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def label(response: Column) -> Column:
    """The first label made of digits only, else -1.  The range is not checked."""
    digits = F.regexp_extract(response, LABEL_DIGITS, 1)
    number = F.coalesce(digits.try_cast("bigint"), F.lit(2**63 - 1))
    return F.when(digits == "", F.lit(MISSING).cast("bigint")).otherwise(number)


def accuracy_reward(response: Column, answer: Column) -> Column:
    """Up to 2, falling with the distance from the answer; -1 without a label."""
    found = label(response)
    distance = F.abs(answer.cast("double") - found.cast("double"))
    return (F.when(found == MISSING, F.lit(-1.0))
            .otherwise(F.coalesce(2 * F.exp(-0.5 * distance), F.lit(0.0))))


def strict_format_reward(response: Column) -> Column:
    """The response is the two tagged parts and nothing else."""
    whole = rf"^{BLANK}*{WHOLE_FORMAT}{BLANK}*$".replace("(?s)", "")
    return F.when(response.rlike("(?s)" + whole), F.lit(FORMAT_REWARD)).otherwise(F.lit(0.0))


def soft_format_reward(response: Column) -> Column:
    """The two tagged parts occur somewhere in the response."""
    return F.when(response.rlike(WHOLE_FORMAT), F.lit(FORMAT_REWARD)).otherwise(F.lit(0.0))


def tag_reward(response: Column) -> Column:
    """A share for each tag line that occurs exactly once, less without a label."""
    once = [F.when(count_literal(response, tag) == 1, F.lit(TAG_WEIGHT)).otherwise(F.lit(0.0))
            for tag in COUNTED_TAGS]
    penalty = F.when(label(response) == MISSING, F.lit(NO_LABEL_PENALTY)).otherwise(F.lit(0.0))
    total = once[0]
    for part in once[1:]:
        total = total + part
    return total - penalty
