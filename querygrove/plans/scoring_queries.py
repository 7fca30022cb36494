"""Word and name overlap between candidate and gold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqltext
from ..operators import scoring
from . import fixtures as fx
from . import oracle_text as duck
from .registry import query

SKIPPED = ", ".join(f"'{w}'" for w in sqltext.NOT_AN_ALIAS)


def _all(pattern: str, text: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, '{pattern}', {group})"


def duck_code(text: str) -> str:
    return rf"regexp_replace({text}, '(''[^'']*'')|--[^\n]*|/\*(?s:.*?)\*/', ' ', 'g')"


def duck_clauses(code: str) -> str:
    return rf"regexp_replace({code}, '{sqltext.CLAUSE_WORD}', '; \1', 'g')"


def duck_aliases(text: str) -> str:
    code = duck_clauses(f"lower({duck_code(text)})")
    bare = f"regexp_replace({code}, '{sqltext.CAST_TAIL}', ')', 'g')"
    found = (f"list_concat({_all(sqltext.ALIAS_AFTER_AS, bare, 1)}, list_concat("
             f"{_all(sqltext.ALIAS_AFTER_TABLE, code, 1)}, {_all(sqltext.ALIAS_AFTER_BRACKET, code, 1)}))")
    return f"list_distinct([a for a in {found} if a NOT IN ({SKIPPED})])"


def duck_tokens(text: str, aliases: str) -> str:
    return f"[w for w in {_all(duck.WORD, f'lower({text})')} if NOT list_contains(list_concat({aliases}, ['as']), w)]"


# Queries with more alias forms than the candidates have.
MORE = """CASE cand_id % 3 WHEN 0 THEN generated_query
 WHEN 1 THEN 'SELECT CAST(p.p_size AS INT) AS "n", count(*) cnt FROM part p JOIN supplier AS s ON p.p_size = s.s_nationkey WHERE s.s_name <> ' || chr(39) || 'as x' || chr(39)
 ELSE 'SELECT t.c FROM (SELECT count(*) AS c FROM ' || CASE WHEN cand_id % 2 = 0 THEN 'nation' ELSE 'region' END || ') t, nation JOIN part x ON x.p_size = n_nationkey WHERE n_name = ' || chr(39) || 'x' || chr(39) || ' AND r_name = p_name' END"""
GRAMS = f"""
SELECT cand_id, t, a FROM (SELECT cand_id, a, {duck_tokens('q', 'a')} AS t
 FROM (SELECT cand_id, q, {duck_aliases('q')} AS a FROM (SELECT cand_id, {MORE} AS q FROM candidates) x) y) z"""


def _more(spark, sf_dir):
    return fx.sql(spark, sf_dir, "candidates", f"SELECT cand_id, {MORE} AS q FROM candidates")


def _sorted_text(items):
    return F.array_join(F.array_sort(items), " | ")


@query("sc_aliases", fx.with_views("candidates", f"SELECT cand_id, array_to_string(list_sort(a), ' | ') AS aliases FROM ({GRAMS}) g"))
def aliases(spark, sf_dir):
    return _more(spark, sf_dir).select("cand_id", _sorted_text(sqltext.aliases(F.col("q"))).alias("aliases"))


@query("sc_ngrams", fx.with_views("candidates", f"""
SELECT cand_id, array_to_string(list_sort(list_distinct(t)), ' | ') AS words,
 array_to_string(list_sort(list_distinct([t[i] || ' ' || t[i + 1] for i in range(1, len(t))])), ' | ') AS pairs FROM ({GRAMS}) g"""))
def ngrams(spark, sf_dir):
    text = F.col("q")
    return _more(spark, sf_dir).select("cand_id", _sorted_text(sqltext.ngrams(text, 1)).alias("words"),
                                       _sorted_text(sqltext.ngrams(text, 2)).alias("pairs"))


def duck_jaccard(rows: str, keep: str, left: str = "generated_query", right: str = "gold_query") -> str:
    return f"""
SELECT {keep}, CASE WHEN len(l) + len(r) = 0 THEN 0.0
 ELSE CAST(len(list_intersect(l, r)) AS DOUBLE) / (len(l) + len(r) - len(list_intersect(l, r))) END AS ngram_jaccard
FROM (SELECT {keep}, list_distinct([lt[i] || ' ' || lt[i + 1] for i in range(1, len(lt))]) AS l,
  list_distinct([rt[i] || ' ' || rt[i + 1] for i in range(1, len(rt))]) AS r
 FROM (SELECT {keep}, {duck_tokens(left, 'la')} AS lt, {duck_tokens(right, 'ra')} AS rt
  FROM (SELECT {keep}, {left}, {right}, {duck_aliases(left)} AS la, {duck_aliases(right)} AS ra FROM {rows}) a) b) c"""


@query("sc_ngram_jaccard", fx.with_views("candidates", f"""
SELECT cand_id, round(ngram_jaccard, 6) AS ngram_jaccard FROM ({duck_jaccard('candidates', 'cand_id')}) j"""))
def ngram_jaccard(spark, sf_dir):
    scored = scoring.ngram_jaccard(fx.view(spark, sf_dir, "candidates"))
    return scored.select("cand_id", F.round("ngram_jaccard", 6).alias("ngram_jaccard"))


def duck_recall(rows: str, keep: str, names: str = "db_columns") -> str:
    words = f"list_distinct({_all(duck.WORD, duck_code('{}'))})"
    return f"""
SELECT {keep}, CASE WHEN len(g) > 0 THEN CAST(len(list_intersect(g, p)) AS DOUBLE) / len(g) END AS schema_linking
FROM (SELECT {keep}, [w for w in gw if list_contains(names, lower(w))] AS g, [w for w in pw if list_contains(names, lower(w))] AS p
 FROM (SELECT {keep}, names, {words.replace('{}', 'gold_query')} AS gw, {words.replace('{}', 'generated_query')} AS pw
  FROM {rows} JOIN (SELECT db_id AS names_db, list_distinct(list_concat(list(lower(table_name)), list(lower(column_name)))) AS names
   FROM {names} GROUP BY db_id) n ON names_db = db_id) a) b"""


@query("sc_schema_recall", fx.with_views("candidates db_columns", f"""
SELECT cand_id, round(schema_linking, 6) AS schema_linking FROM ({duck_recall('candidates', 'cand_id')}) r"""))
def schema_recall(spark, sf_dir):
    scored = scoring.schema_recall(fx.view(spark, sf_dir, "candidates"), fx.view(spark, sf_dir, "db_columns"))
    return scored.select("cand_id", F.round("schema_linking", 6).alias("schema_linking"))


# Whether a candidate parses is known here from the way it was made.
PARSES = "CASE WHEN generated_query LIKE 'SELEC %' THEN 0.0 ELSE 1.0 END"
SCORED = f"""
SELECT c.*, j.ngram_jaccard, r.schema_linking, CAST({PARSES} AS DOUBLE) AS syntax_check FROM candidates c
JOIN ({duck_jaccard('candidates', 'cand_id')}) j ON c.cand_id = j.cand_id
JOIN ({duck_recall('candidates', 'cand_id')}) r ON c.cand_id = r.cand_id"""


def scored(rows, columns):
    """Candidate rows with the three scores; parse results as made."""
    checked = rows.withColumn("syntax_check", F.expr(f"CAST({PARSES} AS DOUBLE)"))
    return scoring.ngram_jaccard(scoring.schema_recall(checked, columns))


@query("sc_composite", fx.with_views("candidates db_columns", f"""
SELECT cand_id, CAST(floor(label) * 4 + floor(syntax_check) * 2 + floor(schema_linking) * 2 + floor(ngram_jaccard) * 2 AS INT) AS answer,
 round(label * 4 + syntax_check * 2 + schema_linking * 2 + ngram_jaccard * 2, 6) AS graded FROM ({SCORED}) s"""))
def composite(spark, sf_dir):
    rows = scored(fx.view(spark, sf_dir, "candidates"), fx.view(spark, sf_dir, "db_columns"))
    parts = [F.col(c) for c in ("label", "syntax_check", "schema_linking", "ngram_jaccard")]
    return rows.select("cand_id", scoring.composite(*parts).alias("answer"),
                       F.round(scoring.composite(*parts, graded=True), 6).alias("graded"))


# What each form of those texts uses, known from the way it was made.
KIND = "CASE cand_id % 3 WHEN 0 THEN cand_id % 8 WHEN 1 THEN 8 ELSE 9 + cand_id % 2 END"
USES = {0: "part.p_name part.p_size", 1: "part.p_name part.p_size", 2: "part.p_name part.p_size", 3: "part.p_name part.p_size",
        4: "part.p_brand", 5: "part.p_name part.p_brand", 7: "supplier.s_name",
        8: "part.p_size supplier.s_nationkey supplier.s_name",
        9: "part.p_size nation.n_nationkey nation.n_name part.p_name", 10: "part.p_size nation.n_nationkey nation.n_name part.p_name"}
NAMES = {0: "part", 1: "part", 2: "part", 3: "part", 4: "part", 5: "part", 7: "supplier", 8: "part supplier",
         9: "nation part", 10: "region nation part"}


def _listed(rows: dict[int, str]) -> str:
    return "(VALUES " + ", ".join(f"({k}, '{n}')" for k, names in rows.items() for n in names.split()) + ") v(kind, name)"


def _used(rows: dict[int, str]) -> str:
    return f"""used AS (SELECT DISTINCT db_id, query, split_part(name, '.', 1) AS table_name, split_part(name, '.', 2) AS column_name
 FROM (SELECT db_id, {MORE} AS query, {KIND} AS kind FROM candidates) q JOIN {_listed(rows)} USING (kind))"""


def _expected(rows: dict[int, str], select: str) -> str:
    return fx.with_views("candidates", select).replace(f"\n{select}", f",\n{_used(rows)}\n{select}")


# Nested and correlated texts, one for each part, over the same catalog.
NESTED = {
    "'SELECT s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name = ' || chr(39) || 'N' || k || chr(39) || ')'":
        "supplier.s_name supplier.s_nationkey nation.n_nationkey nation.n_name",
    "'SELECT s.s_name FROM supplier s WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = s.s_nationkey AND s_acctbal > ' || k || ')'":
        "supplier.s_name supplier.s_nationkey supplier.s_acctbal nation.n_nationkey",
    "'SELECT x.p_name FROM part x WHERE x.p_size > (SELECT max(x.s_nationkey) FROM supplier x WHERE x.s_suppkey < ' || k || ') AND x.p_brand <> x.s_acctbal'":
        "part.p_name part.p_size part.p_brand supplier.s_nationkey supplier.s_suppkey",
    "'SELECT n_name FROM nation WHERE n_regionkey = ' || k || ' UNION SELECT r_name FROM region WHERE n_nationkey > 1'":
        "nation.n_name nation.n_regionkey region.r_name",
    "'SELECT d.n_name, d.k FROM (SELECT n_name, count(*) AS k FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name) d WHERE d.k > ' || k || ' AND d.s_acctbal > s_suppkey'":
        "nation.n_name nation.n_nationkey supplier.s_nationkey",
    "'SELECT upper(substr(p_name, 1, ' || k || ')), coalesce(p_brand, ' || chr(39) || 'from nation, r' || chr(39) || ') FROM part, (SELECT r_name FROM region) r WHERE (p_size, p_type) IN (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > (SELECT avg(p_retailprice) FROM part p2 WHERE p2.p_size = part.p_partkey)) AND s_nationkey = 1'":
        "part.p_name part.p_brand part.p_size part.p_type part.p_retailprice part.p_partkey region.r_name supplier.s_suppkey supplier.s_name supplier.s_acctbal",
    "'WITH c AS (SELECT s_suppkey AS z FROM supplier WHERE s_name LIKE ' || chr(39) || k || chr(39) || ') SELECT z, s_name FROM c JOIN (nation JOIN region r ON n_regionkey = r.r_regionkey) ON n_nationkey = c.z -- part p_name'":
        "supplier.s_suppkey supplier.s_name nation.n_regionkey nation.n_nationkey region.r_regionkey",
}
NESTED_TEXTS = f"""SELECT 'db' || CAST(p_partkey % 3 AS STRING) AS db_id, kind, CASE kind {' '.join(f'WHEN {i} THEN {t}' for i, t in enumerate(NESTED))} END AS query
FROM (SELECT p_partkey, CAST(p_partkey AS STRING) AS k, p_partkey % {len(NESTED)} AS kind FROM part) p"""


def _queries(spark, sf_dir):
    rows = fx.sql(spark, sf_dir, "candidates", f"SELECT db_id, {MORE} AS q FROM candidates")
    return scoring.distinct_queries(rows, "q")


def columns_used(spark, sf_dir):
    return scoring.columns_by_table(_queries(spark, sf_dir), fx.view(spark, sf_dir, "db_columns"))


@query("sc_scoped_columns", f"""
SELECT DISTINCT db_id, query, split_part(name, '.', 1) AS table_name, split_part(name, '.', 2) AS column_name
FROM ({NESTED_TEXTS}) q JOIN {_listed(dict(enumerate(NESTED.values())))} USING (kind)""")
def scoped_columns(spark, sf_dir):
    texts = fx.sql(spark, sf_dir, "", NESTED_TEXTS).select("db_id", "query").distinct()
    return scoring.columns_by_table(texts, fx.view(spark, sf_dir, "db_columns"))


@query("sc_tables_used", _expected(NAMES, "SELECT db_id, query, table_name FROM used"))
def tables_used(spark, sf_dir):
    return scoring.tables_used(_queries(spark, sf_dir), fx.view(spark, sf_dir, "db_columns"))


@query("sc_columns_by_table", _expected(USES, "SELECT * FROM used"))
def columns_by_table(spark, sf_dir):
    return columns_used(spark, sf_dir)


@query("sc_union_schema", _expected(USES, """SELECT db_id, table_name, array_to_string(list_sort(list(DISTINCT column_name)), ' ') AS columns, count(DISTINCT column_name) AS n_columns
FROM used GROUP BY db_id, table_name"""))
def union_schema(spark, sf_dir):
    union = scoring.union_schema(columns_used(spark, sf_dir), ["db_id"])
    # One list per table, as long as the table is wide.
    return union.groupBy("db_id", "table_name").agg(
        F.array_join(F.array_sort(F.collect_set("column_name")), " ").alias("columns"),
        F.count(F.lit(1)).alias("n_columns"))
