"""The guard, labels, errors and time limit of recorded queries."""

import json

import pytest

from querygrove.operators import execution
from querygrove.plans.generation import labelled_answers

QUERY = "db_id string, query string"


@pytest.fixture(scope="module")
def tables():
    def read(session, db_id):
        return {"t": session.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "n int, s string")}
    return read


@pytest.fixture(scope="module")
def session(spark, tables):
    return execution.candidate_session(spark, "d", tables)


@pytest.mark.parametrize("text", [
    "DROP TABLE t", "INSERT INTO t VALUES (3, 'c')", "CREATE TABLE x AS SELECT 1",
    "1) q; DROP VIEW t; SELECT * FROM (SELECT 1", "SELECT reflect('java.lang.System', 'getenv')",
    "SELECT java_method('java.lang.System', 'nanoTime')", "SELECT IDENTIFIER('ref' || 'lect')('a', 'b')",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`", "SELECT nope FROM t", "SELEC n FRM t", "", "t", "SELECT `reflect`('java.lang.System', 'getenv')", "SELECT reflect /* x */ ('a', 'b')",
])
def test_refused(session, text):
    with pytest.raises(Exception):
        execution.planned(session, text)


@pytest.mark.parametrize("text", [
    "SELECT n FROM t;", "SELECT n FROM t -- note", "WITH a AS (SELECT n FROM t) SELECT * FROM a", "SELECT n, n FROM t ORDER BY 1 LIMIT 1",
    "SELECT 'reflect(' FROM t",
])
def test_admitted(session, text):
    assert execution.planned(session, text).collect()


LABELS = [
    ("SELECT n FROM t", "SELECT n AS m FROM t ORDER BY n DESC", 1, "--"),
    ("SELECT DISTINCT n FROM t", "SELECT n FROM t", 1, "--"),
    ("SELECT n FROM t", "SELECT CAST(n AS DOUBLE) FROM t", 1, "--"),
    ("SELECT n FROM t", "SELECT CAST(n AS STRING) FROM t", 0, "incorrect answer"),
    ("SELECT n, s FROM t", "SELECT s, n FROM t", 0, "incorrect answer"),
    ("SELECT n FROM t WHERE n > 5", "SELECT n FROM t WHERE n > 6", 0, "incorrect answer"),
    ("SELECT CAST(NULL AS INT) FROM t", "SELECT CAST(NULL AS STRING) FROM t", 1, "--"),
    ("SELECT 9007199254740993 FROM t", "SELECT 9007199254740992 FROM t", 0, "incorrect answer"),
    ("SELECT n FROM t", "SELECT n / 0 FROM t", 0, "incorrect answer"),
    ("SELECT 1.50 FROM t", "SELECT CAST(1.5 AS DOUBLE) FROM t", 1, "--"),
]


def test_labels_errors_and_previews(spark, tables):
    rows = [(i, "d", gold, other) for i, (gold, other, _, _) in enumerate(LABELS)]
    rows += [(90, "d", "SELECT n FROM t", "SELEC n"), (91, "d", "SELECT n FROM t", "SELECT CAST(raise_error('boom') AS INT) FROM t")]
    df = spark.createDataFrame(rows, "i int, db_id string, gold_query string, generated_query string")
    texts = df.selectExpr("db_id", "gold_query AS query").union(df.selectExpr("db_id", "generated_query"))
    results = execution.run_queries(spark, texts, tables, with_preview=True, batch=4)
    got = {r.i: (r.exec_res, r.exec_err) for r in execution.labelled(df, results).collect()}
    for i, (_, _, res, err) in enumerate(LABELS):
        assert got[i] == (res, err), LABELS[i]
    assert got[90][0] == 0 and got[90][1] == "not a query"
    assert got[91][0] == 0 and got[91][1] not in ("--", "incorrect answer")
    shown = {r["query"]: r.preview for r in results.collect()}
    assert shown["SELECT n, s FROM t"] == 'Rows: 3, Columns: 2, Results: [[1, "a"], [2, "b"], [2, "b"]]'
    assert shown["SELECT n FROM t WHERE n > 5"] == "Rows: 0, Columns: 0, Results: []"
    assert shown["SELEC n"].startswith("Error: ")


def test_time_limit(spark, tables):
    slow = "SELECT count(*) FROM range(100000000) a WHERE sha2(cast(id AS string), 512) LIKE sha2(cast(id + 1 AS string), 512)"
    texts = spark.createDataFrame([("d", slow), ("d", "SELECT n FROM t")], QUERY)
    results = {r["query"]: r for r in execution.run_queries(spark, texts, tables, seconds=4).collect()}
    assert results[slow].error == "timeout"
    assert results["SELECT n FROM t"].n_distinct == 2


SHAPED = [
    "SELECT n FROM t WHERE n > {}", "SELECT s, count(*) FROM t WHERE n >= {} GROUP BY s", "SELECT count(*) FROM t WHERE n = {}",
    "SELECT sum(n), max(s) FROM t WHERE n <> {} AND s = 'b'", "SELECT n FROM t GROUP BY n HAVING count(*) > {}",
    "SELECT n FROM t WHERE n = (SELECT max(n) FROM t WHERE n < {})", "SELECT CASE WHEN n = {} THEN 'x' ELSE s END FROM t",
    "SELECT a.n FROM t a JOIN t b ON a.n = b.n AND b.n > {}", "SELECT n FROM t WHERE n > {} ORDER BY n LIMIT 1",
    "SELECT n FROM t WHERE s = '{}' -- s = 'z'", "SELECT s FROM t WHERE n > {} UNION ALL SELECT 'u = 7' FROM t WHERE n < {}",
    "WITH c AS (SELECT n FROM t WHERE n > {}) SELECT count(*), count(DISTINCT n) FROM c", "SELECT DISTINCT n > {} FROM t",
    "SELECT n, count(*) FROM t GROUP BY 1 HAVING max(n) > {}", "SELECT t.n FROM t WHERE EXISTS (SELECT 1 FROM t u WHERE u.n = t.n AND u.n = {})",
]


def test_shapes_give_what_each_text_gives(spark, session, tables):
    texts = [text.format(v, v) for text in SHAPED for v in (0, 1, 2, 3)] + ["SELECT n FROM t WHERE n > 1000000000000", "SELECT n FROM t WHERE s = 'it''s'"]
    rows = spark.createDataFrame([("d", x) for x in texts], QUERY)
    shapes = execution.with_shapes(rows).select("shape").distinct().count()
    assert shapes == len(SHAPED) + 2
    got = {r["query"]: (r.n_columns, r.n_distinct, r.x1, r.x2, r.error) for r in execution.run_queries(spark, rows, tables).collect()}
    for x in texts:
        assert got[x] == (*execution.fingerprint(execution.planned(session, x)).first(), None), x


def test_one_failing_text_hides_no_other_of_its_shape(spark, tables):
    texts = [f"SELECT CASE WHEN n = {v} THEN CAST(raise_error('boom') AS INT) ELSE n END FROM t" for v in (1, 5, 6)]
    got = {r["query"]: r for r in execution.run_queries(spark, spark.createDataFrame([("d", x) for x in texts], QUERY), tables).collect()}
    assert got[texts[0]].error and got[texts[0]].n_distinct is None
    assert [got[x].n_distinct for x in texts[1:]] == [2, 2] and not got[texts[1]].error


def test_lifted_literals(spark):
    rows = spark.createDataFrame([("d", "SELECT 'a = 1', 2 FROM t WHERE x = 3 AND y <> 'k' /* z = 4 */ AND q >= 5.5 LIMIT 6"), ("d", "SELECT 1")], QUERY)
    got = {r.shape: r.literals for r in execution.with_shapes(rows).collect()}
    hole = execution.HOLE
    assert got == {f"SELECT 'a = 1', 2 FROM t WHERE x = {hole}i{hole} AND y <> {hole}s{hole} /* z = 4 */ AND q >= 5.5 LIMIT 6": ["3", "k"], "SELECT 1": []}


def test_only_own_tables_are_visible(spark, session, tables):
    spark.range(1).createOrReplaceGlobalTempView("secret")
    spark.range(1).createOrReplaceTempView("other")
    for text in ("SELECT * FROM global_temp.secret", "SELECT n FROM t WHERE n IN (SELECT id FROM global_temp.secret)",
                 "SELECT * FROM other", "WITH a AS (SELECT * FROM global_temp.secret) SELECT * FROM a"):
        with pytest.raises(execution.Refused):
            execution.planned(session, text)


def test_a_run_that_took_too_long_has_no_label(spark):
    fields = "db_id string, query string, n_columns int, n_distinct bigint, x1 bigint, x2 bigint, preview string, error string"
    results = spark.createDataFrame([("d", "a", 1, 1, 1, 1, None, None), ("d", "b", None, None, None, None, None, "timeout")], fields)
    rows = spark.createDataFrame([(1, "d", "a", "a"), (2, "d", "a", "b"), (3, "d", "b", "a")], "i int, db_id string, gold_query string, generated_query string")
    got = {r.i: (r.exec_res, r.exec_err) for r in execution.labelled(rows, results).collect()}
    assert got == {1: (1, "--"), 2: (None, "timeout"), 3: (None, "timeout")}


def test_syntax_checks(spark, tables):
    texts = spark.createDataFrame([("d", "SELECT n FROM t"), ("d", "SELECT nope FROM t")], QUERY)
    checks = {r["query"]: r.syntax_check for r in execution.syntax_checks(spark, texts, tables).collect()}
    assert checks == {"SELECT n FROM t": 1.0, "SELECT nope FROM t": 0.0}


def test_labelled_answers(spark, tables):
    fence = "`" * 3
    rows = [("m", "d", "q", 0, "SELECT n FROM t", f"{fence}sql\nSELECT n\nFROM t\n{fence}"),
            ("m", "d", "q", 1, "SELECT n FROM t", "SELECT n  FROM t"), ("m", "d", "q", 2, "SELECT n FROM t", "SELECT s FROM t")]
    answers = spark.createDataFrame(rows, "source_model string, db_id string, question string, position int, gold_query string, model_answer string")
    got = {r.position: (r.generated_query, r.label) for r in labelled_answers(spark, answers, tables).collect()}
    assert got == {0: ("SELECT n FROM t", 1), 2: ("SELECT s FROM t", 0)}


VALUES = [None, "", "a", "A", 'q"uote', "back\\slash", "[list]", "]", "tab\tnew\nline", "\x01\x1f", "\x7f", "é ü", "\U0001f600", "'s", "null", "{}"]


@pytest.fixture(scope="module")
def many():
    """40,000 rows: a bound for most texts, none for small ones, and one value in a third of all rows."""
    def read(session, db_id):
        texts = session.createDataFrame(list(enumerate(VALUES)), "k int, s string")
        rows = session.range(0, 40000, 1, 6).selectExpr(
            "CAST(id % 50 AS INT) AS n", "CASE WHEN id % 3 = 0 THEN 2 ELSE CAST(id * 7919 % 15001 AS INT) END AS m", f"CAST(id % {len(VALUES)} AS INT) AS k")
        return {"t": rows.join(texts, "k").select("n", "m", "s")}
    return read


SHOWN = ["SELECT s, m FROM t WHERE n > 24", "SELECT s, m FROM t WHERE n > 47", "SELECT m FROM t WHERE n > 3", "SELECT m FROM t WHERE n > 49",
         "SELECT m, s FROM t WHERE m = 77", "SELECT m, s FROM t WHERE m = 2", "SELECT m FROM t WHERE m = 2 AND n = 5", "SELECT s FROM t",
         "SELECT count(*) FROM t", "SELECT m FROM t WHERE n > 3 ORDER BY m DESC, n", "SELECT repeat(s, 300) FROM t WHERE n > 1"]


def test_previews_show_the_least_of_all_rows(spark, many):
    queries = spark.createDataFrame([("d", x) for x in SHOWN], QUERY)
    got = {r["query"]: r.preview for r in execution.run_queries(spark, queries, many, with_preview=True).collect()}
    session = execution.candidate_session(spark, "d", many)
    for x in SHOWN:
        rows = [tuple(r) for r in session.sql(x).collect()]
        printed = [json.dumps(list(r), ensure_ascii=False)[:execution.PREVIEW_CHARS] for r in rows]
        if " ORDER BY " not in x:
            printed.sort(key=lambda text: text.encode())
        columns = len(rows[0]) if rows else 0
        want = f"Rows: {len(rows)}, Columns: {columns}, Results: [{', '.join(printed[:20])}]"[:execution.PREVIEW_CHARS]
        assert got[x].lower() == want.lower(), x  # JSON's hexadecimal escapes may be in either case


def test_few_rows_are_ranked_for_a_preview(spark, many, tmp_path):
    """Every row is compared with the bound of its text, and only those below it are ranked."""
    session = execution.candidate_session(spark, "d", many)
    texts = execution.with_shapes(spark.createDataFrame([("d", f"SELECT m FROM t WHERE n > {v}") for v in (3, 9, 24)], QUERY))
    texts.write.parquet(str(tmp_path / "texts"))
    texts = session.read.parquet(str(tmp_path / "texts"))
    first = texts.selectExpr("*", "size(literals) AS n_literals").first()
    shapes = [(first, execution.planned(session, first["query"]))]
    execution._bounded(session, shapes, texts, (20, 2000)).write.parquet(str(tmp_path / "bounds"))
    bounded = session.read.parquet(str(tmp_path / "bounds"))
    assert bounded.filter("bound IS NULL").count() == 0
    every = execution._rows_of(*shapes[0], texts, session).count()
    ranked = execution._printed_rows(*shapes[0], bounded, session, 20, 2000).count()
    assert every > 80000 and ranked < every / 10
