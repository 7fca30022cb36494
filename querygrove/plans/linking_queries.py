"""Value linking over the text cells of many databases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import minhash
from ..operators import linking, profiling, value_store
from ..session import fresh_path, write_and_read
from . import fixtures as fx
from .registry import query

A = "[" + ", ".join(str(a) for a, _ in minhash.coefficients()) + "]"
B = "[" + ", ".join(str(b) for _, b in minhash.coefficients()) + "]"


def _duck(names: str, ctes: str, select: str) -> str:
    return fx.with_views(names, "SELECT 0").rsplit("\nSELECT 0", 1)[0] + ",\n" + ctes + "\n" + select


ELIGIBLE = """SELECT db_id, table_name, column_name FROM {columns} c WHERE contains(data_type, 'TEXT')
 AND NOT regexp_matches(lower(column_name), '_id| id|url|email|web|time|phone|date|address') AND NOT suffix(column_name, 'Id')
 AND NOT EXISTS (SELECT 1 FROM {keys} k WHERE k.kind = 'pk' AND k.db_id = c.db_id AND lower(k.column_name) = lower(c.column_name))"""
LENGTHS = """lengths AS (SELECT db_id, table_name, column_name, CAST(sum(length(value)) AS BIGINT) AS sum_of_lengths, count(*) AS count_distinct
  FROM (SELECT DISTINCT * FROM cells WHERE value IS NOT NULL) d GROUP BY 1, 2, 3)"""
GATE = """(contains(lower(column_name), 'name') AND sum_of_lengths < 5000000)
 OR (sum_of_lengths < 2000000 AND sum_of_lengths / count_distinct < 25) OR count_distinct < 100"""
VALUES = f""" vals AS (SELECT DISTINCT c.db_id, c.table_name, c.column_name, c.value FROM cells c
  JOIN ({ELIGIBLE.format(columns='cell_columns', keys='cell_keys')}) e USING (db_id, table_name, column_name) WHERE c.value IS NOT NULL)"""


def _shingles(text: str) -> str:
    return f"CASE WHEN length({text}) < 3 THEN [{text}] ELSE list_distinct([substr({text}, i, 3) for i in range(1, length({text}) - 1)]) END"


def _indexed(name: str, source: str, columns: str, text: str) -> str:
    """DuckDB CTEs that add signature and bands to ``source``."""
    return f""" {name}_h AS (SELECT {columns}, [CAST('0x' || substr(md5(s), 1, 8) AS BIGINT) for s in {_shingles(text)}] AS hs FROM {source}),
 {name}_s AS (SELECT {columns}, [list_min([(a[i] * h + b[i]) % {minhash.PRIME} for h in hs]) for i in range(1, 101)] AS sig
  FROM (SELECT *, CAST({A} AS BIGINT[]) AS a, CAST({B} AS BIGINT[]) AS b FROM {name}_h) x),
 {name} AS (SELECT {columns}, sig, [CAST('0x' || substr(md5(CAST(k AS VARCHAR) || '-' || array_to_string(sig[k * 4 + 1:k * 4 + 4], '-')), 1, 15) AS BIGINT)
   for k in range(0, 25)] AS bands FROM {name}_s)"""


INDEX = f"{VALUES},\n{_indexed('idx', 'vals', 'db_id, table_name, column_name, value', 'value')}"
PROBES = r""" kw AS (SELECT DISTINCT db_id, trim(keyword) AS keyword FROM keywords),
 subs AS (SELECT DISTINCT db_id, keyword, substring FROM (
  SELECT db_id, keyword, keyword AS substring FROM kw
  UNION ALL SELECT db_id, keyword, substr(keyword, 1, i - 1) FROM (SELECT *, unnest(range(1, length(keyword) + 1)) AS i FROM kw) x WHERE substr(keyword, i, 1) = ' '
  UNION ALL SELECT db_id, keyword, substr(keyword, i + 1) FROM (SELECT *, unnest(range(1, length(keyword) + 1)) AS i FROM kw) x WHERE substr(keyword, i, 1) = ' '
  UNION ALL SELECT db_id, keyword, trim(substr(keyword, strpos(keyword, '=') + 1)) FROM kw WHERE strpos(keyword, '=') > 0 AND trim(substr(keyword, strpos(keyword, '=') + 1)) <> '') u),
 probe_texts AS (SELECT DISTINCT db_id, substring FROM subs)"""
SETS = f"""{VALUES},
{PROBES},
 value_sets AS (SELECT db_id, table_name, column_name, value, {_shingles('value')} AS s FROM vals),
 probe_sets AS (SELECT db_id, substring, {_shingles('substring')} AS s FROM probe_texts),
 met AS (SELECT p.db_id, p.substring, v.table_name, v.column_name, v.value, any_value(p.n) + any_value(v.n) AS total, count(*) AS common
  FROM (SELECT *, len(s) AS n, unnest(s) AS g FROM probe_sets) p JOIN (SELECT *, len(s) AS n, unnest(s) AS g FROM value_sets) v
   ON p.db_id = v.db_id AND p.g = v.g GROUP BY 1, 2, 3, 4, 5),
 alike AS (SELECT * EXCLUDE (total), total - common AS either, CAST(common AS DOUBLE) / (total - common) AS jaccard FROM met)"""
BEST = """ best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_id, substring ORDER BY jaccard DESC, value, table_name, column_name) AS rn
  FROM alike WHERE common * 100 >= either * 45) r WHERE rn <= 10)"""
BANDED = f"""{VALUES},
{PROBES},
{_indexed('idx', 'vals', 'db_id, table_name, column_name, value', 'value')},
{_indexed('prb', 'probe_texts', 'db_id, substring', 'substring')},
 pairs AS (SELECT DISTINCT p.db_id, p.substring, v.table_name, v.column_name, v.value, p.sig AS ps, v.sig AS vs
  FROM (SELECT *, unnest(bands) AS band FROM prb) p JOIN (SELECT *, unnest(bands) AS band FROM idx) v ON p.db_id = v.db_id AND p.band = v.band)"""
ALL = "cells cell_columns cell_keys keywords"


def _lengths(spark, sf_dir):
    return profiling.text_lengths(_distinct(spark, sf_dir))


def _distinct(spark, sf_dir):
    return profiling.distinct_values(profiling.value_counts(fx.view(spark, sf_dir, "cells")))


def _values(spark, sf_dir):
    eligible = linking.eligible_columns(fx.view(spark, sf_dir, "cell_columns"), fx.view(spark, sf_dir, "cell_keys"))
    return linking.unique_values(_distinct(spark, sf_dir), eligible)


def _index(spark, sf_dir):
    return linking.value_index(_values(spark, sf_dir))


def _keywords(spark, sf_dir):
    return fx.view(spark, sf_dir, "keywords")


@query("vl_eligible_columns", fx.with_views("lake_columns lake_keys", ELIGIBLE.format(columns="lake_columns", keys="lake_keys")))
def eligible_columns(spark, sf_dir):
    found = linking.eligible_columns(fx.stored(spark, sf_dir, "lake_columns"), fx.stored(spark, sf_dir, "lake_keys"))
    return found.select("db_id", "table_name", "column_name")


@query("vl_size_gate", _duck("cells", LENGTHS, f"SELECT *, ({GATE}) AS fit FROM lengths"))
def size_gate(spark, sf_dir):
    return linking.size_gate(_lengths(spark, sf_dir))


@query("vl_skip_column", """
SELECT source AS table_name, lang AS column_name, CAST(sum(length(text)) AS BIGINT) AS sum_of_lengths, count(*) AS count_distinct,
 sum(length(text)) > 50000 AND sum(length(text)) / count(*) > 20 AS skipped
FROM (SELECT DISTINCT source, lang, text FROM documents) d GROUP BY source, lang""")
def skip_column(spark, sf_dir):
    cells = fx.table(spark, sf_dir, "documents").select(
        F.lit("docs").alias("db_id"), F.col("source").alias("table_name"), F.col("lang").alias("column_name"),
        F.col("text").alias("value"))
    lengths = profiling.text_lengths(profiling.distinct_values(profiling.value_counts(cells)))
    return lengths.withColumn("skipped", linking.skip_column()).drop("db_id")


@query("vl_values", _duck("cells cell_columns cell_keys", VALUES, "SELECT * FROM vals"))
def values(spark, sf_dir):
    return _values(spark, sf_dir)


@query("vl_shingles", f"""SELECT p_partkey, array_to_string(list_sort({_shingles("p_name || ' ' || p_type")}), '|') AS shingles,
 len({_shingles('left(p_type, p_size % 5)')}) AS n_short FROM part""")
def shingles(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    text = F.concat("p_name", F.lit(" "), "p_type")
    short = F.substring("p_type", F.lit(1), F.col("p_size") % 5)
    return part.select("p_partkey", F.array_join(F.array_sort(minhash.shingles(text)), "|").alias("shingles"),
                       F.size(minhash.shingles(short)).cast("bigint").alias("n_short"))


@query("vl_minhash", _duck("cells cell_columns cell_keys", INDEX, """
SELECT db_id, table_name, column_name, value, array_to_string(sig, ' ') AS signature FROM idx"""))
def signatures(spark, sf_dir):
    return _index(spark, sf_dir).select("db_id", "table_name", "column_name", "value",
                                        F.array_join(F.col("signature").cast("array<string>"), " ").alias("signature"))


@query("vl_bands", _duck("cells cell_columns cell_keys", INDEX, """
SELECT db_id, table_name, column_name, value, unnest(bands) AS band FROM idx"""))
def bands(spark, sf_dir):
    return _index(spark, sf_dir).select("db_id", "table_name", "column_name", "value", F.explode("bands").alias("band"))


@query("vl_probe_strings", _duck("keywords", PROBES, "SELECT * FROM subs"))
def probe_strings(spark, sf_dir):
    return linking.probe_strings(_keywords(spark, sf_dir)).select("db_id", "keyword", "substring")


@query("vl_probe_ranks", _duck("keywords", PROBES, """
SELECT db_id, keyword, substring, CAST(row_number() OVER (PARTITION BY db_id, keyword ORDER BY length(substring) DESC, substring DESC) AS INT) AS probe_rank FROM subs"""))
def probe_ranks(spark, sf_dir):
    probes = linking.probe_strings(_keywords(spark, sf_dir)).select("db_id", "keyword", "substring").distinct()
    return linking.ranked_probes(probes)


def _probes(spark, sf_dir):
    return linking.probe_strings(_keywords(spark, sf_dir)).select("db_id", "substring")


def _banded(spark, sf_dir):
    return linking.lsh_candidates(linking.probe_index(_probes(spark, sf_dir)), _index(spark, sf_dir))


def _stored(spark, sf_dir):
    return write_and_read(_values(spark, sf_dir), "values"), write_and_read(_probes(spark, sf_dir).distinct(), "probes")


@query("vl_set_join", _duck(ALL, SETS, """
SELECT db_id, substring, table_name, column_name, value, round(jaccard, 6) AS jaccard FROM alike WHERE common * 100 >= either * 80"""))
def set_join(spark, sf_dir):
    values, probes = _stored(spark, sf_dir)
    return linking.near_pairs(probes, values).drop("left_id", "right_id").withColumn("jaccard", F.round("jaccard", 6))


@query("vl_store_near", _duck(ALL, SETS, """
SELECT db_id, substring, table_name, column_name, value, round(jaccard, 6) AS jaccard FROM alike WHERE common * 100 >= either * 80"""))
def store_near(spark, sf_dir):
    """Near values from a store that got the values in two batches, the second one with values of the first."""
    values, probes = _stored(spark, sf_dir)
    part = F.pmod(F.xxhash64("value"), F.lit(3))
    path = fresh_path(spark, "value-store")
    value_store.created(values.filter(part < 2), path, buckets=16)
    store = value_store.opened(spark, path)
    value_store.merge(store, values.filter(part > 0))
    return value_store.near(store, probes, linking.NEAR_PERCENT).withColumn("jaccard", F.round("jaccard", 6))


@query("vl_lsh_candidates", _duck(ALL, BANDED, "SELECT db_id, substring, table_name, column_name, value FROM pairs"))
def lsh_candidates(spark, sf_dir):
    return _banded(spark, sf_dir)


@query("vl_est_jaccard", _duck(ALL, BANDED, """
SELECT db_id, substring, table_name, column_name, value, len([i for i in range(1, 101) if ps[i] = vs[i]]) / 100.0::DOUBLE AS estimated_jaccard FROM pairs"""))
def est_jaccard(spark, sf_dir):
    return linking.estimated(_banded(spark, sf_dir))


@query("vl_topk", _duck(ALL, f"{SETS},\n{BEST}", "SELECT db_id, substring, table_name, column_name, value, round(jaccard, 6) AS jaccard FROM best"))
def topk(spark, sf_dir):
    values, probes = _stored(spark, sf_dir)
    return linking.top_matches(probes, values).withColumn("jaccard", F.round("jaccard", 6))


MATCHES = f"{SETS},\n{BEST},\n found AS (SELECT s.db_id, s.keyword, s.substring, b.table_name, b.column_name, b.value AS similar_value FROM subs s JOIN best b USING (db_id, substring))"


def _matches(spark, sf_dir):
    return linking.matches(_keywords(spark, sf_dir), write_and_read(_values(spark, sf_dir), "values"))


@query("vl_matches", _duck(ALL, MATCHES, "SELECT * FROM found"))
def matches(spark, sf_dir):
    return _matches(spark, sf_dir)


@query("vl_match_map", _duck(ALL, MATCHES, """
SELECT db_id, table_name, column_name, similar_value, count(*) AS n_matches FROM found GROUP BY 1, 2, 3, 4"""))
def match_map(spark, sf_dir):
    return linking.match_map(_matches(spark, sf_dir), ["db_id"])


SIMILAR = "1 - levenshtein(lower(substring), lower(similar_value)) / greatest(length(substring), length(similar_value))"


@query("vl_edit_filter", _duck(ALL, MATCHES, f"""
SELECT *, round({SIMILAR}, 6) AS edit_similarity FROM found WHERE {SIMILAR} >= 0.3"""))
def edit_filter(spark, sf_dir):
    return linking.edit_filter(_matches(spark, sf_dir)).withColumn("edit_similarity", F.round("edit_similarity", 6))


@query("vl_edit_blocks")
def edit_blocks(spark, sf_dir):
    return linking.edit_filter(_matches(spark, sf_dir), blocks=True)


GROUP_OF_VALUES = "PARTITION BY db_id, keyword, table_name, column_name"


@query("vl_similar_entities", _duck(ALL, MATCHES, f"""
SELECT db_id, keyword, substring, table_name, column_name, similar_value, round(edit_similarity, 6) AS edit_similarity, round(embedding_similarity, 6) AS embedding_similarity
FROM (SELECT *, max(embedding_similarity) OVER ({GROUP_OF_VALUES}) AS best FROM (
 SELECT * FROM (SELECT *, max(edit_similarity) OVER ({GROUP_OF_VALUES}) AS top FROM (
  SELECT f.*, {SIMILAR} AS edit_similarity, list_sum([CAST(l.embedding[i] AS DOUBLE) * r.embedding[i] for i in range(1, len(l.embedding) + 1)]) AS embedding_similarity
  FROM found f JOIN embeddings l ON l.vec_id = length(f.substring) JOIN embeddings r ON r.vec_id = length(f.similar_value)) x
  WHERE edit_similarity >= 0.3 AND embedding_similarity >= 0.6) a WHERE edit_similarity >= 0.9 * top) b) c
WHERE embedding_similarity >= 0.9 * best"""))
def similar_entities(spark, sf_dir):
    """The whole flow: probes, closest values, both filters, refinement.  A text's vector is the one of its length."""
    values, probes = _stored(spark, sf_dir)
    texts = probes.select(F.col("substring").alias("text")).union(values.select("value")).distinct()
    stored = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("_length"), "embedding")
    vectors = texts.withColumn("_length", F.length("text")).join(stored, "_length").drop("_length")
    kept = linking.similar_entities(_keywords(spark, sf_dir), values, write_and_read(vectors, "vectors"), by=("keyword",))
    return kept.select("db_id", "keyword", "substring", "table_name", "column_name", "similar_value",
                       F.round("edit_similarity", 6).alias("edit_similarity"),
                       F.round("embedding_similarity", 6).alias("embedding_similarity"))


# Vectors of two texts per stored vector: the vector, and a blend with the next.
BLEND = """SELECT a.vec_id, a.embedding AS l, {blend} AS r FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


@query("vl_embed_filter", f"""
SELECT substring, similar_value, round(s, 6) AS embedding_similarity FROM (
 SELECT 't' || vec_id AS substring, 'v' || vec_id AS similar_value, list_sum([CAST(l[i] AS DOUBLE) * r[i] for i in range(1, len(l) + 1)]) AS s
 FROM ({BLEND.format(blend='[CAST(a.embedding[i] AS DOUBLE) * 0.6 + CAST(b.embedding[i] AS DOUBLE) * 0.8 for i in range(1, len(a.embedding) + 1)]')}) x) y
WHERE s >= 0.6""")
def embed_filter(spark, sf_dir):
    blended = fx.sql(spark, sf_dir, "", BLEND.format(
        blend="zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * 0.6D + CAST(y AS DOUBLE) * 0.8D)"))
    name = F.col("vec_id").cast("string")
    vectors = blended.select(F.concat(F.lit("t"), name).alias("text"), F.col("l").cast("array<double>").alias("embedding")).unionByName(
        blended.select(F.concat(F.lit("v"), name).alias("text"), F.col("r").alias("embedding")))
    pairs = blended.select(F.concat(F.lit("t"), name).alias("substring"), F.concat(F.lit("v"), name).alias("similar_value"))
    return linking.embedding_filter(pairs, vectors).withColumn(
        "embedding_similarity", F.round("embedding_similarity", 6))


GROUP = "PARTITION BY request_id, table_name, column_name"


@query("vl_refine", fx.with_views("entities", f"""
SELECT request_id, table_name, column_name, similar_value, round(edit_similarity, 6) AS edit_similarity, round(embedding_similarity, 6) AS embedding_similarity
FROM (SELECT *, max(embedding_similarity) OVER ({GROUP}) AS best FROM (
 SELECT * FROM (SELECT *, max(edit_similarity) OVER ({GROUP}) AS top FROM entities) a WHERE edit_similarity >= 0.9 * top) b) c
WHERE embedding_similarity >= 0.9 * best"""))
def refine(spark, sf_dir):
    kept = linking.refine(fx.view(spark, sf_dir, "entities"), ["request_id", "table_name", "column_name"])
    return (kept.withColumn("edit_similarity", F.round("edit_similarity", 6))
            .withColumn("embedding_similarity", F.round("embedding_similarity", 6)))


@query("vl_index_roundtrip", _duck("cells cell_columns cell_keys", INDEX, """
SELECT db_id, table_name, column_name, count(*) AS n_values, CAST(sum(bands[1] % 1000003) AS BIGINT) AS band_sum FROM idx GROUP BY 1, 2, 3"""))
def index_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "value-index")
    linking.write_index(_index(spark, sf_dir), path)
    return linking.read_index(spark, path).groupBy("db_id", "table_name", "column_name").agg(
        F.count(F.lit(1)).alias("n_values"), F.sum(F.col("bands")[0] % 1000003).alias("band_sum"))
