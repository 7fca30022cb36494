"""Views over the given tables that stand in for the inputs of each job.

Each text runs unchanged on Spark SQL and on DuckDB.  Every view is derived
from whole tables, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import fresh_path

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

VIEWS: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {}


def _view(name: str, text: str, needs: str = "") -> None:
    VIEWS[name] = text.strip()
    NEEDS[name] = needs.split()


_view("candidates", """
SELECT p_partkey AS cand_id,
 p_partkey % 97 AS question_id,
 'Question ' || CAST(p_partkey % 97 AS STRING) AS question,
 CASE WHEN p_partkey % 97 % 4 = 0 THEN '' ELSE 'size above bound' END AS evidence,
 'db' || CAST((p_partkey % 97) % 3 AS STRING) AS db_id,
 'm' || CAST(p_partkey % 4 AS STRING) AS source_model,
 'SELECT p_name FROM part WHERE p_size > ' || CAST((p_partkey % 97) % 50 AS STRING) AS gold_query,
 CASE p_partkey % 8
  WHEN 0 THEN 'SELECT p_name FROM part WHERE p_size > ' || CAST((p_partkey % 97) % 50 AS STRING)
  WHEN 1 THEN 'select  p_name' || chr(10) || 'from part where p_size > ' || CAST((p_partkey % 97) % 50 AS STRING) || ' ;'
  WHEN 2 THEN 'SELECT p.p_name AS n FROM part AS p WHERE p.p_size > ' || CAST((p_partkey % 97) % 50 AS STRING)
  WHEN 3 THEN 'SELECT p_name FROM part WHERE p_size >= ' || CAST((p_partkey % 97) % 50 AS STRING) || ' -- near'
  WHEN 4 THEN 'SELECT p_brand , COUNT( * ) FROM part GROUP BY p_brand'
  WHEN 5 THEN '/* x */ SELECT p_name FROM part WHERE p_brand = ' || chr(39) || p_brand || chr(39)
  WHEN 6 THEN 'SELEC p_name FRM part'
  ELSE 'SELECT s_name FROM supplier' END AS generated_query,
 CASE WHEN p_partkey % 8 < 3 THEN 1 ELSE 0 END AS label
FROM part
""")

# The model answer around each candidate: a fence, two fences, none, a fence
# with an upper-case tag, or a fence inside tagged text.
_view("answers", """
SELECT c.*, CASE cand_id % 5
  WHEN 0 THEN 'First try' || chr(10) || repeat(chr(96), 3) || 'sql' || chr(10) || 'SELECT 0' || chr(10) || repeat(chr(96), 3)
   || ' fixed: ' || repeat(chr(96), 3) || 'sql' || chr(10) || generated_query || chr(10) || repeat(chr(96), 3)
  WHEN 1 THEN '  ' || generated_query || chr(10)
  WHEN 2 THEN repeat(chr(96), 3) || 'SQL' || chr(10) || generated_query || repeat(chr(96), 3)
  ELSE '<answer>' || repeat(chr(96), 3) || 'sql ' || generated_query || '  ' || repeat(chr(96), 3) || '</answer>' END AS model_answer
FROM candidates c
""", "candidates")

_view("filter_list", """
SELECT 'Question ' || CAST(r AS STRING) AS question, CASE WHEN r % 8 = 0 THEN 10 ELSE 7 END AS overall_confidence
FROM (SELECT DISTINCT p_partkey % 97 AS r FROM part) t
""")

# Small question groups whose number grows with the table: one group holds the
# rows of one result-file record.
_view("result_rows", """
SELECT c.*, 'Task ' || CAST(CAST(floor(cand_id / 32) AS BIGINT) AS STRING) AS task,
 CAST(floor((cand_id % 32) / 4) AS INT) AS position
FROM answers c
""", "answers candidates")

_view("responses", """
SELECT d.doc_id AS resp_id, coalesce(l.quality, 0) * 4 + coalesce(l.toxic, 0) * 2 AS answer,
 CASE d.doc_id % 6
  WHEN 0 THEN '<reasoning>' || chr(10) || d.lang || chr(10) || '</reasoning>' || chr(10) || '<label>' || chr(10) || CAST(d.n_chars % 11 AS STRING) || chr(10) || '</label>'
  WHEN 1 THEN '<reasoning>' || d.lang || '</reasoning><label>' || CAST(d.n_chars % 11 AS STRING) || '</label>'
  WHEN 2 THEN '<label>' || CAST(d.n_chars % 11 AS STRING) || '.5</label>'
  WHEN 3 THEN 'no tags ' || d.lang
  WHEN 4 THEN '<label>-1</label> then <label> 7 </label>'
  ELSE '<reasoning>' || chr(10) || 'a' || chr(10) || '</reasoning>' || chr(10) || '<reasoning>' || chr(10) || '</reasoning>' || chr(10) || '<label>' || chr(10) || '99' || chr(10) || '</label>' END AS response
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")

_view("rounds", """
SELECT conv_id AS sample_id, CAST(floor(turn / 2) AS INT) + 1 AS round,
 CAST(length(text) % 11 AS INT) AS judge_label, CAST(length(text) % 2 AS INT) AS label,
 CASE WHEN length(text) % 5 = 0 THEN 0 ELSE 1 END AS has_sql
FROM conversations WHERE role = 'assistant'
""")

# The same rounds with their texts: the query, the reasoning and, now and then,
# a model failure.
_view("round_texts", """
SELECT sample_id, round, judge_label, label, has_sql,
 CASE WHEN label + judge_label = 7 THEN NULL ELSE 'SELECT ' || CAST(judge_label AS STRING) || ' AS r' || CAST(round AS STRING) END AS query,
 'scored ' || CAST(judge_label AS STRING) AS judge_reasoning,
 CASE WHEN label + judge_label = 7 THEN 'no answer' END AS error
FROM rounds
""", "rounds")

# The recorded texts behind those rounds: a fenced query or none, and the judge's answer, which a failed round lacks.
_view("round_responses", """
SELECT sample_id, round, CASE WHEN has_sql = 1 THEN 'Then' || chr(10) || repeat(chr(96), 3) || 'sql' || chr(10) || 'SELECT ' || CAST(judge_label AS STRING)
   || ' AS r' || CAST(round AS STRING) || chr(10) || repeat(chr(96), 3) ELSE 'none for round ' || CAST(round AS STRING) END AS model_response,
 CASE WHEN label + judge_label <> 7 THEN '<reasoning>scored ' || CAST(judge_label AS STRING) || '</reasoning>' || chr(10)
   || '<label>' || CAST(judge_label AS STRING) || '</label>' END AS judge_response
FROM rounds
""", "rounds")

_view("cat", """
SELECT * FROM (VALUES ('part','p_partkey','BIGINT'),('part','p_name','TEXT'),('part','p_brand','TEXT'),
 ('part','p_type','TEXT'),('part','p_size','INT'),('part','p_retailprice','DOUBLE'),
 ('supplier','s_suppkey','BIGINT'),('supplier','s_name','TEXT'),('supplier','s_nationkey','INT'),('supplier','s_acctbal','DOUBLE'),
 ('nation','n_nationkey','INT'),('nation','n_name','TEXT'),('nation','n_regionkey','INT'),
 ('region','r_regionkey','INT'),('region','r_name','TEXT')) AS t(table_name, column_name, data_type)
""")

_view("cat_keys", """
SELECT * FROM (VALUES ('part','p_partkey','pk',NULL,NULL),('supplier','s_suppkey','pk',NULL,NULL),
 ('nation','n_nationkey','pk',NULL,NULL),('region','r_regionkey','pk',NULL,NULL),
 ('supplier','s_nationkey','fk','nation',NULL),('nation','n_regionkey','fk','region','r_regionkey'))
 AS t(table_name, column_name, kind, ref_table, ref_column)
""")

# The catalog of each database a candidate names.
_view("db_columns", """
SELECT 'db0' AS db_id, cat.* FROM cat
UNION ALL SELECT 'db1' AS db_id, cat.* FROM cat
UNION ALL SELECT 'db2' AS db_id, cat.* FROM cat
""", "cat")

_view("db_keys", """
SELECT 'db0' AS db_id, cat_keys.* FROM cat_keys
UNION ALL SELECT 'db1' AS db_id, cat_keys.* FROM cat_keys
UNION ALL SELECT 'db2' AS db_id, cat_keys.* FROM cat_keys
""", "cat_keys")

# Counts of each column of those databases, which hold the same tables.
_PROFILED = [(t, c) for t, names in {
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "nation": "n_nationkey n_name n_regionkey", "region": "r_regionkey r_name"}.items() for c in names.split()]
_view("db_profile", "SELECT d.db_id, p.* FROM (SELECT DISTINCT db_id FROM db_columns) d CROSS JOIN (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS n_nonnull, count(DISTINCT {c}) AS n_distinct, "
    f"count(*) - count({c}) AS n_null FROM {t}" for t, c in _PROFILED) + ") p", "db_columns")

# A catalog of many databases, one per supplier: part types as tables, brands
# as columns, with the name forms the column rules look for.
_view("lake_columns", """
SELECT db_id, table_name, CAST(bn AS INT) AS ordinal,
 CASE bn % 8 WHEN 0 THEN 'Name_' || CAST(bn AS STRING) WHEN 1 THEN 'note_' || CAST(bn AS STRING)
  WHEN 2 THEN 'email_' || CAST(bn AS STRING) WHEN 3 THEN 'link' || CAST(bn AS STRING) || 'Id'
  WHEN 4 THEN 'startDate' || CAST(bn AS STRING) WHEN 5 THEN 'city_' || CAST(bn AS STRING)
  WHEN 6 THEN 'ref_id' || CAST(bn AS STRING) ELSE 'title' || CAST(bn AS STRING) END AS column_name,
 CASE bn % 5 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'DATE' WHEN 2 THEN 'text' ELSE 'TEXT' END AS data_type
FROM (SELECT DISTINCT 'db' || CAST(l_suppkey AS STRING) AS db_id, p_type AS table_name,
   CAST(replace(p_brand, 'Brand#', '') AS INT) AS bn
  FROM lineitem JOIN part ON l_partkey = p_partkey) b
""")

_view("lake_edges", """
SELECT db_id, table_name, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal
FROM lake_columns GROUP BY db_id, table_name
""", "lake_columns")

# The first column of a table is its key.  The last one refers to another
# table, in another case; for ECONOMY without naming the column, for PROMO to a
# table that does not exist.
_view("lake_keys", """
SELECT c.db_id, c.table_name, c.column_name, 'pk' AS kind,
 CAST(NULL AS STRING) AS ref_table, CAST(NULL AS STRING) AS ref_column
FROM lake_columns c JOIN lake_edges e ON c.db_id = e.db_id AND c.table_name = e.table_name AND c.ordinal = e.first_ordinal
UNION ALL
SELECT c.db_id, c.table_name, c.column_name, 'fk' AS kind,
 CASE c.table_name WHEN 'ECONOMY' THEN 'Large' WHEN 'PROMO' THEN 'missing' WHEN 'LARGE' THEN 'small' ELSE 'ECONOMY' END AS ref_table,
 CASE WHEN c.table_name IN ('ECONOMY', 'STANDARD') THEN NULL ELSE 'CITY_5' END AS ref_column
FROM lake_columns c JOIN lake_edges e ON c.db_id = e.db_id AND c.table_name = e.table_name AND c.ordinal = e.last_ordinal
WHERE e.last_ordinal > e.first_ordinal AND c.table_name <> 'SMALL'
""", "lake_edges lake_columns")

_view("lake_stats", """
SELECT 'db' || CAST(l_suppkey AS STRING) AS db_id, p_type AS table_name,
 CAST(replace(p_brand, 'Brand#', '') AS INT) AS ordinal,
 count(*) AS n_nonnull, count(DISTINCT l_quantity) AS n_distinct,
 CAST(sum(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_null,
 CAST(CAST(min(l_quantity) AS INT) AS STRING) AS low_value, max(flag_status) AS high_value
FROM (SELECT l_suppkey, l_partkey, l_quantity, l_tax, l_returnflag || l_linestatus AS flag_status FROM lineitem) l
JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3
""")

_view("lake_profile", """
SELECT c.db_id, c.table_name, c.column_name, n_nonnull, n_distinct, n_null, low_value, high_value
FROM lake_stats s JOIN lake_columns c ON s.db_id = c.db_id AND s.table_name = c.table_name AND s.ordinal = c.ordinal
""", "lake_stats lake_columns")

_view("lake_descriptions", """
SELECT db_id, lower(table_name) AS table_name, upper(column_name) AS column_name,
 CASE ordinal % 3 WHEN 0 THEN '' WHEN 1 THEN lower(column_name) ELSE 'meaning ' || CAST(ordinal AS STRING) END AS expanded_name,
 CASE WHEN ordinal % 2 = 0 THEN 'described' || chr(10) || 'over lines' ELSE '' END AS column_description,
 'plain' AS data_format,
 CASE WHEN ordinal % 4 = 0 THEN 'any value' ELSE '' END AS value_description
FROM lake_columns WHERE data_type <> 'INTEGER'
""", "lake_columns")

# Requested names, in another case, with tables and columns that do not exist.
_view("lake_requests", """
SELECT db_id, lower(table_name) AS table_name, upper(column_name) AS column_name
FROM lake_columns WHERE (column_name LIKE 'Name%' OR column_name LIKE 'city%' OR column_name LIKE 'link%') AND table_name <> 'MEDIUM'
UNION ALL SELECT db_id, 'nowhere' AS table_name, column_name FROM lake_columns WHERE column_name LIKE 'title%'
UNION ALL SELECT db_id, table_name, 'no such column' AS column_name FROM lake_columns WHERE column_name LIKE 'note%'
""", "lake_columns")

# Text cells of many small databases, 500 customers or parts in each.
_view("cells", """
SELECT 'shop' || CAST(CAST(floor(c_custkey / 500) AS BIGINT) AS STRING) AS db_id, 'customer' AS table_name, 'c_name' AS column_name, c_name AS value FROM customer
UNION ALL SELECT 'shop' || CAST(CAST(floor(c_custkey / 500) AS BIGINT) AS STRING), 'customer', 'c_mktsegment', c_mktsegment FROM customer
UNION ALL SELECT 'shop' || CAST(CAST(floor(p_partkey / 500) AS BIGINT) AS STRING), 'part', 'p_name', p_name FROM part
UNION ALL SELECT 'shop' || CAST(CAST(floor(p_partkey / 500) AS BIGINT) AS STRING), 'part', 'p_brand', p_brand FROM part
UNION ALL SELECT 'shop' || CAST(CAST(floor(p_partkey / 500) AS BIGINT) AS STRING), 'part', 'p_type', p_type FROM part
""")

_view("cell_columns", """
SELECT DISTINCT db_id, table_name, column_name, 'TEXT' AS data_type FROM cells
""", "cells")

_view("cell_keys", """
SELECT DISTINCT db_id, 'part' AS table_name, 'p_type' AS column_name, 'pk' AS kind FROM cells
""", "cells")

# Keywords of the questions over each of those databases: misspelt names,
# hints, and names cut from another table.
_view("keywords", """
SELECT DISTINCT 'shop' || CAST(CAST(floor(p_partkey / 500) AS BIGINT) AS STRING) AS db_id, replace(p_name, 'in', 'im') AS keyword FROM part
UNION SELECT 'shop' || CAST(CAST(floor(p_partkey / 500) AS BIGINT) AS STRING), 'p_brand = ' || p_brand FROM part
UNION SELECT 'shop' || CAST(CAST(floor(s_suppkey / 50) AS BIGINT) AS STRING), '  Customer' || substr(s_name, 9) FROM supplier
""")

# Matched values with their two similarities.
_view("entities", """
SELECT l_orderkey AS request_id, l_returnflag AS table_name, l_linestatus AS column_name,
 'v' || CAST(l_partkey AS STRING) AS similar_value, l_quantity / 50 AS edit_similarity, 1 - l_discount * 5 AS embedding_similarity
FROM lineitem
""")


def _ordered(names: list[str]) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS[name]:
            add(need)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def with_views(names: str, select: str) -> str:
    """``select`` with the named views, and those they need, as leading CTEs."""
    parts = [f"{n} AS (\n{VIEWS[n]}\n)" for n in _ordered(names.split())]
    return ("WITH " + ",\n".join(parts) + "\n" + select) if parts else select


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, names: str, select: str) -> DataFrame:
    """Run fixture text on the tables of one directory."""
    for name in TABLES:
        if name in select or any(name in VIEWS[v] for v in _ordered(names.split())):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(with_views(names, select))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, name, f"SELECT * FROM {name}")


_STORED: dict[tuple[str, str, str], tuple[str, StructType]] = {}
# Views over all lines that several stored views are made from: each is stored once for them.
SHARED = ["lake_columns", "lake_stats"]
_LINE_KEYS = VIEWS["lake_columns"][VIEWS["lake_columns"].index("(SELECT DISTINCT"):]


def _from_stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view's rows, from the shared views as they are stored."""
    if name == "lake_columns" and (spark.sparkContext.applicationId, sf_dir, "lake_stats") in _STORED:
        # The groups of the counted lines are the different keys of the lines.
        stored(spark, sf_dir, "lake_stats").createOrReplaceTempView("lake_stats")
        return spark.sql(VIEWS[name].replace(_LINE_KEYS, "(SELECT db_id, table_name, ordinal AS bn FROM lake_stats) b"))
    needs = _ordered([name])[:-1]
    shared = [need for need in needs if need in SHARED]
    if not shared:
        return view(spark, sf_dir, name)
    for need in shared:
        stored(spark, sf_dir, need).createOrReplaceTempView(need)
    rest = [f"{n} AS (\n{VIEWS[n]}\n)" for n in needs if n not in SHARED]
    return spark.sql(("WITH " + ",\n".join(rest) + "\n" if rest else "") + VIEWS[name])


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view written once per application to the shared folder.

    For views that stand in for stored inputs, such as a catalog.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        frame = _from_stored(spark, sf_dir, name)
        path = fresh_path(spark, name)
        frame.write.parquet(path)
        _STORED[key] = path, frame.schema
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)
