"""Readers on hand-made files."""

import json

from pyspark.sql import functions as F

from querygrove.functions import sqltext
from querygrove.sources import descriptions, records, tables
from querygrove.streaming import arriving_results


def test_result_arrays(spark, tmp_path):
    record = {"question": "q", "answers": ["x", "y"], "generated_queries": ["a", "b"], "labels": [1, 0],
              "gold_query": "g", "db_id": "d", "evidence": ""}
    for model in ("alpha", "beta-2.5"):
        name = f"2024-01-01_10-00-00_{model}_train_results.json"
        (tmp_path / name).write_text(json.dumps([record, {**record, "question": "r"}], indent=4))
    rows = records.read_results(spark, str(tmp_path)).collect()
    assert sorted((r.source_model, r.question) for r in rows) == [
        ("alpha", "q"), ("alpha", "r"), ("beta-2.5", "q"), ("beta-2.5", "r")]
    assert rows[0].labels == [1, 0]


def test_questions_without_evidence(spark, tmp_path):
    path = tmp_path / "dev.json"
    path.write_text(json.dumps([{"question": "q", "db_id": "d", "SQL": "s"}]))
    assert records.read_questions(spark, str(path)).first().evidence == ""


def test_filter_list(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text('question,overall_confidence\n"a, ""b""",10\nc,7\n')
    assert sorted(map(tuple, records.read_filter_list(spark, str(path)).collect())) == [('a, "b"', 10), ("c", 7)]


def test_descriptions_in_both_encodings(spark, tmp_path):
    head = "original_column_name,column_name,column_description,data_format,value_description\n"
    folder = tmp_path / "shop" / "database_description"
    folder.mkdir(parents=True)
    (folder / "Orders.csv").write_bytes(b"\xef\xbb\xbf" + (head + ' Total , total é,"sum\nof lines",real,Not useful: none\n').encode())
    (folder / "items.csv").write_bytes((head + "Name,,commonsense evidence: it\u2019s \u20ac,text,\n").encode("cp1252"))
    (folder / "empty.csv").write_bytes(b"")
    rows = {(r.table_name, r.column_name): r for r in descriptions.read_descriptions(
        spark, f"{tmp_path}/*/database_description/*.csv").collect()}
    assert set(rows) == {("orders", "total"), ("items", "name")}
    total, name = rows[("orders", "total")], rows[("items", "name")]
    assert (total.db_id, total.expanded_name, total.column_description, total.value_description) == (
        "shop", "total é", "sum of lines", ": none")
    assert name.column_description == "it\u2019s \u20ac" and name.value_description == ""


def test_fetch_modes(spark):
    df = spark.range(30).withColumn("x", F.col("id") % 3)
    assert tables.fetch(df, "all").count() == 30 and tables.fetch(df, 7, ["id"]).count() == 7
    assert tables.fetch(df, "one", ["id"]).first().id == 0
    assert tables.fetch(df, "random", ["id"]).first().id < 10


def test_manifest_keeps_plain_values(spark):
    row = records.run_manifest(spark, "r1", {"a": 1, "b": object(), "c": [1]}).first()
    assert json.loads(row.arguments) == {"a": 1, "c": [1]}


def test_text_columns_work_on_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    record = {"question": "q", "generated_queries": ["SELECT A ;"], "answers": ["x"], "labels": [1]}
    (folder / "run_m_train_results.json").write_text(json.dumps(record) + "\n")
    rows = arriving_results(spark, str(folder)).select("source_model", F.explode("generated_queries").alias("q"))
    stream = rows.select("source_model", sqltext.normalize_sql(F.col("q")).alias("norm_sql"))
    query = (stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.sql("SELECT * FROM arrived").collect()] == [("m", "select a ")]
