"""Sampling, caps, prompts and splits, and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts, rewards
from ..operators import sampling, scoring
from ..session import fresh_path
from ..sources import records, tables
from . import fixtures as fx
from . import flagship
from . import oracle_text as duck
from . import scoring_queries as sq
from .registry import query

SHUFFLE = "md5('42|' || CAST(cand_id AS VARCHAR)), cand_id"


def _candidates(spark, sf_dir):
    return fx.view(spark, sf_dir, "candidates")


@query("ds_cap_per_question", fx.with_views("candidates", f"""
SELECT cand_id, question FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY {SHUFFLE}) AS rn FROM candidates) t
WHERE rn <= 5"""))
def cap_per_question(spark, sf_dir):
    rows = _candidates(spark, sf_dir).select("cand_id", "question")
    return sampling.cap_per_group(rows, ["question"], ["cand_id"])


@query("ds_sample_half", fx.with_views("candidates", f"""
SELECT cand_id, question FROM (SELECT *, row_number() OVER (ORDER BY {SHUFFLE}) AS rn, count(*) OVER () AS n FROM candidates) t
WHERE rn <= round_even(n * 0.5, 0)"""))
def sample_half(spark, sf_dir):
    return sampling.sample_fraction(_candidates(spark, sf_dir).select("cand_id", "question"), ["cand_id"])


@query("ds_sample_threshold", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {duck.uint32('42', 'l_orderkey', 'l_linenumber')} < 2147483648")
def sample_threshold(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return sampling.sample_fraction(rows, ["l_orderkey", "l_linenumber"], exact=False)


@query("ds_shuffle", fx.with_views("candidates", f"SELECT cand_id, row_number() OVER (ORDER BY {SHUFFLE}) AS shuffle_rank FROM candidates"))
def shuffle(spark, sf_dir):
    return sampling.ranked(_candidates(spark, sf_dir).select("cand_id"), ["cand_id"])


@query("ds_split", fx.with_views("candidates", f"""
SELECT cand_id, question, CASE WHEN {duck.uint32('42', 'question')} < 429496729 THEN 'validation' ELSE 'train' END AS split FROM candidates"""))
def split(spark, sf_dir):
    return sampling.split(_candidates(spark, sf_dir).select("cand_id", "question"), ["question"], 0.1)


@query("ds_length_filter", rf"""SELECT doc_id FROM documents
WHERE len(regexp_extract_all(text, '({duck.WORD}|[^\p{{L}}\p{{N}}_\s])', 1)) <= 2000""")
def length_filter(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return sampling.short_enough(rows, "text").select("doc_id")


LABEL_TEXT = duck.strip_text("regexp_extract(response, '(?s)<label>(.*?)</label>', 1)")


@query("ds_drop_failed", fx.with_views("responses", f"""
SELECT resp_id, CAST({LABEL_TEXT} AS BIGINT) AS label FROM responses WHERE TRY_CAST({LABEL_TEXT} AS BIGINT) IS NOT NULL AND NOT contains({LABEL_TEXT}, '.')"""))
def drop_failed(spark, sf_dir):
    return sampling.drop_failed(_parsed(spark, sf_dir)).select("resp_id", "label")


def _parsed(spark, sf_dir):
    rows = fx.view(spark, sf_dir, "responses").withColumn("label", rewards.judge_label(F.col("response")))
    error = F.when(F.col("label").isNull(), F.concat(F.lit("no label: "), rewards.judge_label_text(F.col("response"))))
    return rows.withColumn("error", error)


@query("ds_failure_counts", fx.with_views("responses", f"""
SELECT 'no label: ' || {LABEL_TEXT} AS error, count(*) AS n_rows FROM responses
WHERE TRY_CAST({LABEL_TEXT} AS BIGINT) IS NULL OR contains({LABEL_TEXT}, '.') GROUP BY 1"""))
def failure_counts(spark, sf_dir):
    return sampling.failure_counts(_parsed(spark, sf_dir))


# Values with braces and percent signs, which the rendering must leave alone.
SLOTS = {
    "DATABASE_SCHEMA": "'schema of ' || db_id || ' {QUESTION} 100%'", "QUESTION": "question", "HINT": "evidence",
    "SQL": "generated_query", "RESULTS": "'Rows: ' || CAST(label AS STRING)",
}


def _duck_template(name: str) -> str:
    parts = prompts.SLOT.split(prompts.load_template(name))
    quoted = ["'" + p.replace("'", "''") + "'" if i % 2 == 0 else f"coalesce({SLOTS[p]}, '')" for i, p in enumerate(parts)]
    return " || ".join(quoted)


def _rendered(spark, sf_dir, name):
    values = {k: F.expr(v) for k, v in SLOTS.items()}
    return _candidates(spark, sf_dir).select("cand_id", prompts.render(prompts.load_template(name), values).alias("prompt"))


@query("ds_prompt", fx.with_views("candidates", f"SELECT cand_id, {_duck_template('score_query')} AS prompt FROM candidates"))
def prompt(spark, sf_dir):
    return _rendered(spark, sf_dir, "score_query")


@query("ds_prompt_binary", fx.with_views("candidates", f"SELECT cand_id, {_duck_template('accept_query')} AS prompt FROM candidates"))
def prompt_binary(spark, sf_dir):
    return _rendered(spark, sf_dir, "accept_query")


@query("ds_prompt_generation", fx.with_views("candidates", f"SELECT cand_id, {_duck_template('write_query')} AS prompt FROM candidates"))
def prompt_generation(spark, sf_dir):
    return _rendered(spark, sf_dir, "write_query")


SYSTEM = "'" + prompts.SYSTEM_MESSAGE.replace("'", "''") + "'"


@query("ds_messages_json", fx.with_views("candidates", f"""
SELECT cand_id, CAST(to_json([{{'role': 'system', 'content': {SYSTEM}}}, {{'role': 'user', 'content': generated_query}}]) AS VARCHAR) AS prompt,
 2 AS n_messages, generated_query AS user_content FROM candidates"""))
def messages_json(spark, sf_dir):
    coded = _candidates(spark, sf_dir).select(
        "cand_id", prompts.encode_messages(prompts.messages(F.col("generated_query"))).alias("prompt"))
    chat = prompts.decode_messages(F.col("prompt"))
    return coded.select("cand_id", "prompt", F.size(chat).alias("n_messages"), chat[1]["content"].alias("user_content"))


@query("ds_scored_roundtrip", fx.with_views("candidates db_columns", f"""
SELECT cand_id, db_id, question, evidence, gold_query, generated_query, label, syntax_check,
 round(schema_linking, 6) AS schema_linking, round(ngram_jaccard, 6) AS ngram_jaccard FROM ({sq.SCORED}) s"""))
def scored_roundtrip(spark, sf_dir):
    scored = sq.scored(_candidates(spark, sf_dir), fx.view(spark, sf_dir, "db_columns"))
    path = fresh_path(spark, "scored")
    records.write_rows(scored.select(
        "cand_id", "db_id", "question", "evidence", "gold_query", "generated_query", "label", "syntax_check",
        F.round("schema_linking", 6).alias("schema_linking"), F.round("ngram_jaccard", 6).alias("ngram_jaccard")), path)
    return spark.read.parquet(path)


# What the schema text of each form of candidate shows, known from the way it was made: the names in it and the key.
SHOWN = {0: "part p_name p_partkey p_size", 4: "part p_brand p_partkey", 5: "part p_brand p_name p_partkey",
         7: "supplier s_name s_suppkey"}
SHOWN |= {1: SHOWN[0], 2: SHOWN[0], 3: SHOWN[0]}
KEY_OF = "CASE s.table_name WHEN 'part' THEN 'p_partkey' ELSE 's_suppkey' END"


def _duck_schemas(remark: str, more: str = "") -> str:
    """CTE ``schema_texts(db_id, kind, txt)``; ``remark`` stands behind each column."""
    rows = ", ".join(f"({kind}, '{words.split()[0]}', '{c}')" for kind, words in SHOWN.items() for c in words.split()[1:])
    return f"""shown(kind, table_name, column_name) AS (VALUES {rows}),
 schema_texts AS (SELECT c.db_id, s.kind, 'CREATE TABLE ' || s.table_name || chr(10) || '(' || chr(10)
   || string_agg(chr(9) || s.column_name || ' ' || c.data_type || ',' || {remark}, chr(10) ORDER BY s.column_name)
   || chr(10) || chr(9) || 'PRIMARY KEY (' || {KEY_OF} || '),' || chr(10) || ');' AS txt
  FROM shown s JOIN db_columns c ON c.table_name = s.table_name AND c.column_name = s.column_name {more} GROUP BY c.db_id, s.kind, s.table_name)"""


def _duck(names: str, ctes: str, select: str) -> str:
    return fx.with_views(names, "SELECT 0").rsplit("\nSELECT 0", 1)[0] + ",\n" + ctes + "\n" + select


@query("cat_schema_for_query", _duck("candidates db_columns", _duck_schemas("''"), """
SELECT DISTINCT c.db_id, c.generated_query AS query, t.txt AS schema_text
FROM candidates c JOIN schema_texts t ON t.db_id = c.db_id AND t.kind = c.cand_id % 8"""))
def schema_for_query(spark, sf_dir):
    queries = scoring.distinct_queries(_candidates(spark, sf_dir))
    return flagship.schemas(queries, fx.view(spark, sf_dir, "db_columns"), fx.view(spark, sf_dir, "db_keys"))


def _tables(sf_dir):
    def read(session, db_id):
        return {t: fx.table(session, sf_dir, t) for t in ("part", "supplier", "nation", "region")}
    return read


def _filter_list(spark, sf_dir):
    """The filter list as users bring it: a CSV file with a header."""
    path = fresh_path(spark, "filter-list")
    fx.view(spark, sf_dir, "filter_list").write.option("header", "true").option("escape", '"').csv(path)
    return records.read_filter_list(spark, path)


def _lake(spark, sf_dir):
    return [fx.view(spark, sf_dir, name) for name in ("candidates", "db_columns", "db_keys")]


def run_flagship(spark, sf_dir):
    return flagship.run(*_lake(spark, sf_dir), _filter_list(spark, sf_dir), _tables(sf_dir),
                        fx.stored(spark, sf_dir, "db_profile"))


REMARK = "' -- counts: non-null ' || f.n_nonnull || ', distinct ' || f.n_distinct || ', null ' || f.n_null || '   '"
WITH_REMARKS = _duck_schemas(REMARK, """JOIN db_profile f ON f.db_id = c.db_id AND f.table_name = c.table_name
   AND f.column_name = c.column_name""")
# The results of each form of candidate: how many rows, and the twenty least of them as text.
ROWS = """list_sort(list({row}))[1:20] AS l"""
NAMES = ROWS.format(row="""'["' || p_name || '"]'""")
PREVIEWS = f"""above AS (SELECT k, count(*) AS n, {NAMES} FROM range(0, 50) r(k) JOIN part ON p_size > k GROUP BY k),
 from_on AS (SELECT k, count(*) AS n, {NAMES} FROM range(0, 50) r(k) JOIN part ON p_size >= k GROUP BY k),
 of_brand AS (SELECT p_brand, count(*) AS n, {NAMES} FROM part GROUP BY p_brand),
 brands AS (SELECT count(*) AS n, {ROWS.format(row="""'["' || p_brand || '", ' || b || ']'""")} FROM (SELECT p_brand, count(*) AS b FROM part GROUP BY 1) x),
 suppliers AS (SELECT count(*) AS n, {ROWS.format(row="""'["' || s_name || '"]'""")} FROM supplier),
 results AS (SELECT cand_id, CASE WHEN kind = 6 THEN 'Error: not a query' ELSE left('Rows: ' || coalesce(n, 0) || ', Columns: '
   || CASE WHEN coalesce(n, 0) = 0 THEN 0 WHEN kind = 4 THEN 2 ELSE 1 END || ', Results: [' || coalesce(array_to_string(l, ', '), '') || ']', 2000) END AS formatted_result
  FROM (SELECT c.cand_id, c.cand_id % 8 AS kind,
    CASE c.cand_id % 8 WHEN 3 THEN e.n WHEN 4 THEN m.n WHEN 5 THEN b.n WHEN 7 THEN s.n ELSE a.n END AS n,
    CASE c.cand_id % 8 WHEN 3 THEN e.l WHEN 4 THEN m.l WHEN 5 THEN b.l WHEN 7 THEN s.l ELSE a.l END AS l
   FROM candidates c JOIN part p ON p.p_partkey = c.cand_id JOIN of_brand b ON b.p_brand = p.p_brand CROSS JOIN brands m CROSS JOIN suppliers s
   LEFT JOIN above a ON a.k = c.question_id % 50 LEFT JOIN from_on e ON e.k = c.question_id % 50) x)"""

# The flagship without its prompt, step by step in SQL.
KEPT = f"""kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_id, question, norm_sql ORDER BY source_model, cand_id) AS rn
   FROM (SELECT *, {duck.normalized('generated_query')} AS norm_sql FROM candidates
    WHERE question NOT IN (SELECT question FROM filter_list WHERE overall_confidence = 10)) n) r WHERE rn = 1),
 scored AS (SELECT k.*, j.ngram_jaccard, CASE WHEN generated_query LIKE 'SELEC %' THEN 0.0 ELSE r.schema_linking END AS schema_linking,
   CASE WHEN generated_query LIKE 'SELEC %' THEN 0.0 ELSE 1.0 END AS syntax_check FROM kept k
  JOIN ({sq.duck_jaccard('kept', 'cand_id')}) j ON k.cand_id = j.cand_id JOIN ({sq.duck_recall('kept', 'cand_id')}) r ON k.cand_id = r.cand_id),
 half AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {SHUFFLE}) AS rank, count(*) OVER () AS n FROM scored) t WHERE rank <= round_even(n * 0.5, 0)),
 capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_id, question ORDER BY {SHUFFLE}) AS place FROM half) t WHERE place <= 5)"""


def _duck_prompt(slots: dict[str, str]) -> str:
    parts = prompts.SLOT.split(prompts.load_template("score_query"))
    return " || ".join("'" + p.replace("'", "''") + "'" if i % 2 == 0 else f"coalesce({slots[p]}, '')" for i, p in enumerate(parts))


PROMPT = _duck_prompt({"DATABASE_SCHEMA": "t.txt", "QUESTION": "c.question", "HINT": "c.evidence", "SQL": "c.generated_query",
                       "RESULTS": "r.formatted_result"})
FLAGSHIP_VIEWS = "candidates filter_list db_columns db_profile"
query("ds_training_rows", _duck(FLAGSHIP_VIEWS, f"{KEPT},\n{WITH_REMARKS},\n{PREVIEWS}", f"""
SELECT c.cand_id, c.db_id, question, evidence, gold_query, CAST(floor(label) * 4 + floor(syntax_check) * 2 + floor(schema_linking) * 2 + floor(ngram_jaccard) * 2 AS INT) AS answer,
 CAST(to_json([{{'role': 'system', 'content': {SYSTEM}}}, {{'role': 'user', 'content': {PROMPT}}}]) AS VARCHAR) AS prompt,
 CASE WHEN {duck.uint32('42', 'question')} < 42949672 THEN 'validation' ELSE 'train' END AS split
FROM capped c JOIN results r ON r.cand_id = c.cand_id LEFT JOIN schema_texts t ON t.db_id = c.db_id AND t.kind = c.cand_id % 8"""))(run_flagship)


@query("ds_scored_rows", _duck(FLAGSHIP_VIEWS, f"{KEPT},\n{WITH_REMARKS},\n{PREVIEWS}", """
SELECT c.cand_id, c.db_id, question, evidence, gold_query, generated_query, t.txt AS schema, label, CAST(syntax_check AS DOUBLE) AS syntax_check,
 round(schema_linking, 6) AS schema_linking, round(ngram_jaccard, 6) AS ngram_jaccard, formatted_result
FROM scored c JOIN results r ON r.cand_id = c.cand_id LEFT JOIN schema_texts t ON t.db_id = c.db_id AND t.kind = c.cand_id % 8"""))
def scored_rows(spark, sf_dir):
    """The scored row as it is stored: scores, schema text and result of each distinct candidate."""
    rows = flagship.scored_rows(*_lake(spark, sf_dir), _tables(sf_dir), _filter_list(spark, sf_dir),
                                fx.stored(spark, sf_dir, "db_profile"))
    return (rows.withColumn("schema_linking", F.round("schema_linking", 6))
            .withColumn("ngram_jaccard", F.round("ngram_jaccard", 6)))


@query("ds_training_answers", fx.with_views("candidates filter_list db_columns", "SELECT 0").rsplit("\nSELECT 0", 1)[0] + f""",
 {KEPT}
SELECT cand_id, db_id, question, CAST(floor(label) * 4 + floor(syntax_check) * 2 + floor(schema_linking) * 2 + floor(ngram_jaccard) * 2 AS INT) AS answer,
 CASE WHEN {duck.uint32('42', 'question')} < 42949672 THEN 'validation' ELSE 'train' END AS split FROM capped""")
def training_answers(spark, sf_dir):
    """The flagship's rows without the prompt; no prompt here is too long."""
    return run_flagship(spark, sf_dir).select("cand_id", "db_id", "question", "answer", "split")


@query("scan_first_n", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5000")
def scan_first_n(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (-F.col("o_totalprice")).alias("_down"))
    return tables.fetch(rows, tables.DEFAULT_ROWS, ["_down", "o_orderkey"]).drop("_down")


@query("scan_random_one", """SELECT c_custkey, c_name FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 10) t
ORDER BY md5('42|' || CAST(c_custkey AS VARCHAR)) LIMIT 1""")
def scan_random_one(spark, sf_dir):
    return tables.fetch(fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "random", ["c_custkey"])
