"""Catalog lookups and schema texts over a lake of databases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog
from ..session import write_and_read
from . import fixtures as fx
from .registry import query

PK = """pk AS (SELECT DISTINCT c.db_id, c.table_name, c.column_name, c.ordinal FROM lake_columns c JOIN lake_keys k
  ON k.db_id = c.db_id AND lower(k.table_name) = lower(c.table_name) AND lower(k.column_name) = lower(c.column_name) WHERE k.kind = 'pk'),
 fk AS (SELECT DISTINCT k.db_id, c.table_name, c.column_name, t.table_name AS ref_table, t.column_name AS ref_column
  FROM lake_keys k JOIN lake_columns c ON k.db_id = c.db_id AND lower(k.table_name) = lower(c.table_name) AND lower(k.column_name) = lower(c.column_name)
  LEFT JOIN (SELECT db_id, lower(table_name) AS t, arg_min(column_name, ordinal) AS c FROM pk GROUP BY 1, 2) p ON p.db_id = k.db_id AND p.t = lower(k.ref_table)
  JOIN lake_columns t ON t.db_id = k.db_id AND lower(t.table_name) = lower(k.ref_table) AND lower(t.column_name) = coalesce(lower(k.ref_column), lower(p.c))
  WHERE k.kind = 'fk')"""
ENRICHED = f"""{PK},
 info AS (SELECT c.*, pk.column_name IS NOT NULL AS primary_key,
  coalesce(o.refs, '') AS foreign_keys, coalesce(i.refs, '') AS referenced_by,
  d.expanded_name, d.column_description, d.data_format, d.value_description,
  s.n_nonnull, s.n_distinct, s.n_null, s.low_value, s.high_value
 FROM lake_columns c LEFT JOIN pk ON pk.db_id = c.db_id AND pk.table_name = c.table_name AND pk.column_name = c.column_name
 LEFT JOIN (SELECT db_id, table_name, column_name, string_agg(ref_table || '.' || ref_column, ',' ORDER BY ref_table, ref_column) AS refs FROM fk GROUP BY 1, 2, 3) o
  ON o.db_id = c.db_id AND o.table_name = c.table_name AND o.column_name = c.column_name
 LEFT JOIN (SELECT db_id, ref_table, ref_column, string_agg(table_name || '.' || column_name, ',' ORDER BY table_name, column_name) AS refs FROM fk GROUP BY 1, 2, 3) i
  ON i.db_id = c.db_id AND i.ref_table = c.table_name AND i.ref_column = c.column_name
 LEFT JOIN lake_descriptions d ON d.db_id = c.db_id AND lower(d.table_name) = lower(c.table_name) AND lower(d.column_name) = lower(c.column_name)
 LEFT JOIN lake_stats s ON s.db_id = c.db_id AND s.table_name = c.table_name AND s.ordinal = c.ordinal)"""
SELECTED = """chosen AS (SELECT DISTINCT t.db_id, t.table_name, c.column_name FROM lake_requests r
  JOIN (SELECT DISTINCT db_id, table_name FROM lake_columns) t ON t.db_id = r.db_id AND lower(t.table_name) = lower(r.table_name)
  LEFT JOIN lake_columns c ON c.db_id = r.db_id AND lower(c.table_name) = lower(r.table_name) AND lower(c.column_name) = lower(r.column_name)),
 tabs AS (SELECT DISTINCT db_id, table_name FROM chosen)"""
CONNECTED = """conn AS (SELECT t.db_id, t.table_name, p.column_name FROM tabs t JOIN pk p ON p.db_id = t.db_id AND p.table_name = t.table_name
  UNION SELECT t.db_id, t.table_name, f.column_name FROM tabs t JOIN fk f ON f.db_id = t.db_id AND f.table_name = t.table_name
   JOIN tabs u ON u.db_id = f.db_id AND u.table_name = f.ref_table
  UNION SELECT t.db_id, t.table_name, f.ref_column FROM tabs t JOIN fk f ON f.db_id = t.db_id AND f.ref_table = t.table_name
   JOIN tabs u ON u.db_id = f.db_id AND u.table_name = f.table_name
  UNION SELECT t.db_id, t.table_name, c.column_name FROM tabs t JOIN lake_columns c ON c.db_id = t.db_id AND c.table_name = t.table_name
   WHERE EXISTS (SELECT 1 FROM chosen s JOIN pk p ON p.db_id = s.db_id AND p.table_name = s.table_name AND p.column_name = s.column_name
    WHERE s.db_id = t.db_id AND lower(s.column_name) = lower(c.column_name) AND s.table_name <> t.table_name))"""
COMMENT = """CASE WHEN trim(body) = '' THEN '' ELSE replace(' --' || body, chr(10), ' ') END"""
BODY = """CASE WHEN low_value IS NULL THEN '' ELSE ' e.g. `' || low_value || '`, `' || high_value || '` |' END
 || CASE WHEN n_nonnull IS NULL THEN '' ELSE ' counts: non-null ' || n_nonnull || ', distinct ' || n_distinct || ', null ' || n_null END
 || ' ' || CASE WHEN trim(coalesce(expanded_name, '')) <> '' AND lower(expanded_name) <> lower(column_name) THEN '| long name ' || expanded_name ELSE '' END
 || ' ' || CASE WHEN coalesce(column_description, '') <> '' THEN '| about ' || column_description ELSE '' END
 || ' ' || CASE WHEN coalesce(value_description, '') <> '' THEN '| values ' || value_description ELSE '' END"""
LAKE = "lake_columns lake_keys lake_descriptions lake_stats lake_requests"


def _duck(names: str, ctes: str, select: str) -> str:
    return fx.with_views(names, "SELECT 0").rsplit("\nSELECT 0", 1)[0] + ",\n" + ctes + "\n" + select


def lake(spark, sf_dir):
    columns = fx.stored(spark, sf_dir, "lake_columns").select(
        "db_id", "table_name", "column_name", "ordinal", "data_type")
    return columns, catalog.resolve_keys(fx.stored(spark, sf_dir, "lake_keys"), columns)


def lake_metadata(spark, sf_dir):
    fx.stored(spark, sf_dir, "lake_stats")  # first: the columns are its groups
    columns, _ = lake(spark, sf_dir)
    keys = catalog.stored_keys(fx.stored(spark, sf_dir, "lake_keys"), columns)
    stats = fx.stored(spark, sf_dir, "lake_profile").withColumn("examples", F.array("low_value", "high_value"))
    return columns, keys, catalog.enriched(columns, keys, fx.stored(spark, sf_dir, "lake_descriptions"), stats)


def _refs(name):
    return F.array_join(F.transform(name, lambda r: F.concat(r["table"], F.lit("."), r["column"])), ",").alias(name)


@query("cat_keys_resolved", _duck("lake_columns lake_keys", PK, "SELECT db_id, table_name, column_name, ref_table, ref_column FROM fk"))
def keys_resolved(spark, sf_dir):
    return lake(spark, sf_dir)[1].foreign


@query("cat_enriched", _duck(LAKE, ENRICHED, """
SELECT db_id, table_name, column_name, ordinal, data_type, primary_key, foreign_keys, referenced_by, expanded_name,
 column_description, value_description, n_nonnull, n_distinct, n_null FROM info"""))
def enriched(spark, sf_dir):
    info = lake_metadata(spark, sf_dir)[2]
    return info.select("db_id", "table_name", "column_name", "ordinal", "data_type", "primary_key",
                       _refs("foreign_keys"), _refs("referenced_by"), "expanded_name",
                       "column_description", "value_description", "n_nonnull", "n_distinct", "n_null")


def selection(spark, sf_dir):
    columns, _ = lake(spark, sf_dir)
    return catalog.subselect(columns, fx.stored(spark, sf_dir, "lake_requests"))


@query("cat_subselect", _duck("lake_columns lake_requests", SELECTED, "SELECT db_id, table_name, column_name FROM chosen"))
def subselect(spark, sf_dir):
    return selection(spark, sf_dir)


@query("cat_connections", _duck("lake_columns lake_keys lake_requests", f"{PK},\n{SELECTED},\n{CONNECTED}",
                                "SELECT db_id, table_name, column_name FROM conn"))
def connections(spark, sf_dir):
    columns, _ = lake(spark, sf_dir)
    keys = catalog.stored_keys(fx.stored(spark, sf_dir, "lake_keys"), columns)
    return catalog.connections(write_and_read(selection(spark, sf_dir), "selection"), columns, keys)


@query("cat_from_records", _duck("lake_columns lake_descriptions", """lists AS (SELECT db_id, table_name, list(column_name ORDER BY ordinal) AS columns
  FROM lake_columns GROUP BY 1, 2)""", """
SELECT l.db_id, l.table_name, array_to_string(columns, ' ') AS columns,
 (SELECT count(*) FROM lake_descriptions d WHERE d.db_id = l.db_id AND lower(d.table_name) = lower(l.table_name) AND d.column_description <> '') AS n_described
FROM lists l"""))
def from_records(spark, sf_dir):
    columns, _ = lake(spark, sf_dir)
    lists = catalog.to_column_lists(columns, "ordinal")
    again = catalog.from_column_lists(lists)
    described = catalog.set_fields(again, fx.stored(spark, sf_dir, "lake_descriptions"), catalog.DESCRIPTION_FIELDS)
    counts = described.groupBy("db_id", "table_name").agg(
        F.count_if(F.col("column_description") != "").alias("n_described"))
    return (lists.join(counts, ["db_id", "table_name"])
            .select("db_id", "table_name", F.array_join("columns", " ").alias("columns"), "n_described"))


@query("cat_column_comment", _duck(LAKE, ENRICHED, f"""
SELECT db_id, table_name, column_name, {COMMENT} AS comment FROM (SELECT *, {BODY} AS body FROM info) b"""))
def column_comment(spark, sf_dir):
    info = lake_metadata(spark, sf_dir)[2]
    return info.select("db_id", "table_name", "column_name", catalog.column_comment().alias("comment"))


@query("cat_column_profile", _duck(LAKE, ENRICHED, """
SELECT db_id, table_name, column_name, 'table `' || table_name || '`' || chr(10) || 'column `' || column_name || '`' || chr(10)
 || CASE WHEN trim(coalesce(expanded_name, '')) <> '' AND lower(trim(expanded_name)) <> lower(trim(column_name)) THEN 'long name `' || expanded_name || '`' || chr(10) ELSE '' END
 || 'type ' || data_type || chr(10)
 || CASE WHEN coalesce(column_description, '') <> '' THEN 'about ' || column_description || chr(10) ELSE '' END
 || CASE WHEN coalesce(value_description, '') <> '' THEN 'values ' || value_description || chr(10) ELSE '' END
 || 'e.g. `' || low_value || '`, `' || high_value || '`' || chr(10) AS column_profile
FROM info WHERE NOT primary_key AND foreign_keys = '' AND referenced_by = ''"""))
def column_profile(spark, sf_dir):
    return catalog.column_profiles(lake_metadata(spark, sf_dir)[2])


TEXT = f"""shown AS (SELECT DISTINCT db_id, table_name, column_name FROM (SELECT * FROM chosen WHERE column_name IS NOT NULL UNION SELECT * FROM conn) u),
 lines AS (SELECT i.db_id, i.table_name, 0 AS part, '' AS k, i.ordinal AS o, chr(9) || i.column_name || ' ' || i.data_type || ',' || {COMMENT} AS line
   FROM (SELECT *, {BODY} AS body FROM info) i JOIN shown s ON s.db_id = i.db_id AND s.table_name = i.table_name AND s.column_name = i.column_name
  UNION ALL SELECT p.db_id, p.table_name, 1, '', 0, chr(9) || 'PRIMARY KEY (' || string_agg(p.column_name, ', ' ORDER BY p.ordinal) || '),'
   FROM pk p JOIN tabs t ON t.db_id = p.db_id AND t.table_name = p.table_name GROUP BY 1, 2
  UNION ALL SELECT f.db_id, f.table_name, 2, f.column_name || '|' || f.ref_table, 0, chr(9) || 'FOREIGN KEY (' || f.column_name || ') REFERENCES ' || f.ref_table || ' (' || f.ref_column || '),'
   FROM fk f JOIN tabs t ON t.db_id = f.db_id AND t.table_name = f.table_name JOIN tabs u ON u.db_id = f.db_id AND u.table_name = f.ref_table),
 texts AS (SELECT db_id, table_name, 'CREATE TABLE ' || table_name || chr(10) || '(' || chr(10)
   || string_agg(line, chr(10) ORDER BY part, k, o, line) || chr(10) || ');' AS txt FROM lines GROUP BY 1, 2)"""


@query("cat_schema_text", _duck(LAKE, f"{ENRICHED},\n{SELECTED},\n{CONNECTED},\n{TEXT}", """
SELECT db_id, string_agg(txt, chr(10) || chr(10) ORDER BY table_name) AS schema_text FROM texts GROUP BY db_id"""))
def schema_text(spark, sf_dir):
    columns, keys, info = lake_metadata(spark, sf_dir)
    return catalog.schema_text(selection(spark, sf_dir), columns, keys, info)


@query("cat_schema_text_shuffled", _duck(LAKE, f"{ENRICHED},\n{SELECTED},\n{CONNECTED},\n{TEXT}".replace(
    "0 AS part, '' AS k", "0 AS part, md5('7|' || i.db_id || '|' || i.table_name || '|' || i.column_name) AS k"), """
SELECT db_id, string_agg(txt, chr(10) || chr(10) ORDER BY md5('7|' || db_id || '|' || table_name)) AS schema_text FROM texts GROUP BY db_id"""))
def schema_text_shuffled(spark, sf_dir):
    columns, keys, info = lake_metadata(spark, sf_dir)
    return catalog.schema_text(selection(spark, sf_dir), columns, keys, info, seed=7)
