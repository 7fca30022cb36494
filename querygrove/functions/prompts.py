"""Prompt text and chat messages as columns."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPLATES = Path(__file__).resolve().parent.parent / "templates"
SLOT = re.compile(r"\{([A-Z_]+)\}")

MESSAGES = "array<struct<role:string,content:string>>"

# The reply format asked for in the system message.
SYSTEM_MESSAGE = "\nAnswer in this form:\n<reasoning>\n...\n</reasoning>\n<label>\n...\n</label>\n"


def load_template(name: str, folder: str | Path = TEMPLATES) -> str:
    """A template's text.  A missing one raises ``FileNotFoundError``."""
    return (Path(folder) / f"{name}.txt").read_text(encoding="utf-8")


def slots(template: str) -> list[str]:
    return SLOT.findall(template)


def render(template: str, values: dict[str, Column]) -> Column:
    """Fill the slots in one pass: braces inside a value are left alone."""
    pattern = SLOT.sub("%s", template.replace("%", "%%"))
    filled = [F.coalesce(values[s].cast("string"), F.lit("")) for s in slots(template)]
    return F.format_string(pattern, *filled)


def messages(user: Column, system: str = SYSTEM_MESSAGE) -> Column:
    """A system and a user message."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))


def encode_messages(chat: Column) -> Column:
    return F.to_json(chat)


def decode_messages(text: Column) -> Column:
    return F.from_json(text, MESSAGES)
