"""Text steps in DuckDB's words, shared by the checks of several queries."""

from __future__ import annotations

BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"


def strip_text(text: str) -> str:
    return f"regexp_replace({text}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '{BLANK}+', ' ', 'g'))"


def normalized(column: str, tail: str = ";+$") -> str:
    text = rf"regexp_replace({column}, '--[^\n]*', '', 'g')"
    text = rf"regexp_replace({text}, '(?s)/\*.*?\*/', '', 'g')"
    text = f"regexp_replace({collapse('lower(' + text + ')')}, '{tail}', '')"
    for mark in (",", "(", ")"):
        text = f"regexp_replace({text}, ' *[{mark}] *', '{mark}', 'g')"
    return text


def cleaned(text: str) -> str:
    code = rf"""regexp_replace({text}, '(''[^'']*''|"[^"]*")|--[^\n]*|/\*(?s:.*?)\*/', '\1', 'g')"""
    return rf"""regexp_replace(replace(replace({code}, chr(10), ' '), '"', ''''), '\\+''', '''', 'g')"""


def extracted(column: str) -> str:
    fenced = f"regexp_extract_all({column}, '(?s)```sql{BLANK}*(.*?){BLANK}*```', 1)"
    return f"coalesce({strip_text(f'list_extract({fenced}, -1)')}, {strip_text(column)})"


def uint32(*parts: str) -> str:
    """The first 32 bits of an md5 over parts joined by a bar."""
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT)"
