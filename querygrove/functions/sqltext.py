"""SQL text as text: extraction, cleaning, normalisation, names and n-grams.

Nothing here parses SQL.  Names are found as words and compared with a catalog
by the scoring operators.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANK, WORD, collapse_blanks, let, strip

# The Markdown fence that marks SQL in a model response.
FENCE = "`" * 3
FENCED_SQL = rf"(?s){FENCE}sql{BLANK}*(.*?){BLANK}*{FENCE}"

# Words that can follow a table name or a closing bracket
# without being an alias.
NOT_AN_ALIAS = [
    "and", "as", "asc", "between", "by", "case", "collate", "cross", "desc", "else", "end",
    "except", "exists", "filter", "from", "full", "group", "having", "in", "inner", "intersect",
    "is", "join", "left", "like", "limit", "natural", "not", "offset", "on", "or", "order",
    "outer", "over", "right", "select", "then", "union", "using", "when", "where", "window", "with",
]

# Type names that follow AS inside a CAST.
CAST_TYPES = [
    "bigint", "blob", "char", "date", "datetime", "decimal", "double", "float", "int", "integer",
    "numeric", "real", "string", "text", "timestamp", "varchar",
]

LITERAL_OR_COMMENT = r"('[^']*')|--[^\n]*|/\*(?s:.*?)\*/"
COMMENT_OUTSIDE_QUOTES = r"('[^']*'|\"[^\"]*\")|--[^\n]*|/\*(?s:.*?)\*/"
CAST_TAIL = (
    rf"\bas{BLANK}+(?:{'|'.join(CAST_TYPES)}){BLANK}*(?:\([^)]*\))?{BLANK}*\)"
)
ALIAS_AFTER_AS = rf"\bas{BLANK}+[\"`\[]?({WORD})"
ALIAS_AFTER_TABLE = rf"\b(?:from|join){BLANK}+[\"`\[]?{WORD}[\"`\]]?{BLANK}+({WORD})"
ALIAS_AFTER_BRACKET = rf"\){BLANK}+({WORD})"


CLAUSE_WORD = rf"\b({'|'.join(w for w in NOT_AN_ALIAS if w != 'as')})\b"


def has_sql_fence(text: Column) -> Column:
    return F.contains(text, F.lit(FENCE + "sql"))


def extract_sql(text: Column, strip_plain: bool = True) -> Column:
    """The last fenced SQL block; without one, the whole text."""
    fenced = F.regexp_extract_all(text, F.lit(FENCED_SQL), F.lit(1))
    plain = strip(text) if strip_plain else text
    return F.coalesce(strip(F.try_element_at(fenced, F.lit(-1))), plain)


def clean_sql(query: Column, strip_comments: bool = True) -> Column:
    """One line, single quotes only, escaped quotes unescaped.

    Comments go first, outside literals, because a line comment would swallow
    the rest of the joined line.
    """
    if strip_comments:
        query = F.regexp_replace(query, COMMENT_OUTSIDE_QUOTES, "$1")
    one_line = F.replace(F.replace(query, F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit("'"))
    return F.regexp_replace(one_line, r"\\+'", "'")


def normalize_sql(query: Column, trim_tail: bool = False) -> Column:
    """The comparison form of a query: no comments, lower case, tight blanks.

    With ``trim_tail`` a trailing run of blanks and semicolons goes as a whole;
    without it one blank before a final semicolon is kept.
    """
    text = F.regexp_replace(query, r"--[^\n]*", "")
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    text = collapse_blanks(F.lower(text))
    text = F.regexp_replace(text, "[ ;]+$" if trim_tail else ";+$", "")
    for mark in (",", "(", ")"):
        text = F.regexp_replace(text, rf" *[{mark}] *", mark)
    return text


def code_only(query: Column) -> Column:
    """The query without comments and with every string literal emptied."""
    return F.regexp_replace(query, LITERAL_OR_COMMENT, " ")


def clauses(code: Column) -> Column:
    """Lower-cased code with a mark before each clause word, so that a pattern
    for a name and its alias cannot run into the next clause."""
    return F.regexp_replace(code, CLAUSE_WORD, "; $1")


def aliases(query: Column) -> Column:
    """Lower-cased table and column aliases, found by their position."""
    code = clauses(F.lower(code_only(query)))
    no_casts = F.regexp_replace(code, CAST_TAIL, ")")
    found = F.array_union(
        F.regexp_extract_all(no_casts, F.lit(ALIAS_AFTER_AS), F.lit(1)),
        F.array_union(
            F.regexp_extract_all(code, F.lit(ALIAS_AFTER_TABLE), F.lit(1)),
            F.regexp_extract_all(code, F.lit(ALIAS_AFTER_BRACKET), F.lit(1)),
        ),
    )
    return F.array_except(found, F.array(*[F.lit(w) for w in NOT_AN_ALIAS]))


def tokens(query: Column) -> Column:
    """Words of the lower-cased query in order, without aliases and ``as``."""
    skip = F.array_append(aliases(query), F.lit("as"))
    all_words = F.regexp_extract_all(F.lower(query), F.lit(f"({WORD})"), F.lit(1))
    return let(F.struct(all_words.alias("words"), skip.alias("skip")),
               lambda q: F.filter(q["words"], lambda w: ~F.array_contains(q["skip"], w)))


def ngrams(query: Column, n: int = 1) -> Column:
    """The set of n-grams over :func:`tokens`, each joined by one space."""
    if n <= 1:
        return F.array_distinct(tokens(query))

    def grams(found: Column) -> Column:
        last = F.size(found) - F.lit(n - 1)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                           lambda i: F.array_join(F.slice(found, i, F.lit(n)), " "))
        return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))

    return let(tokens(query), grams)


def jaccard(left: Column, right: Column) -> Column:
    """Shared share of two sets; 0 when both are empty."""
    both = F.size(F.array_intersect(left, right))
    either = F.size(left) + F.size(right) - both
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def code_words(query: Column) -> Column:
    """Distinct words outside literals and comments, case kept."""
    return F.array_distinct(
        F.regexp_extract_all(code_only(query), F.lit(f"({WORD})"), F.lit(1)))
