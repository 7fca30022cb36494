"""Arrays read in many tasks against the one-task reader."""

import json
import random

import pytest

from querygrove.sources import json_arrays, records

SCHEMA = "a string, b struct<c: array<int>, d: string>, n int"


def record(rng):
    odd = ["}", "{", "\"", "\\", "]", "[", "\\\"}", "é}", "\n", ",", "{\"a\": 1}", "plain words ", "\u2028"]
    text = "".join(rng.choice(odd) for _ in range(rng.randrange(12)))
    return {"a": rng.choice([text, None]), "n": rng.randrange(9), "b": rng.choice([None, {"c": [1, 2], "d": text}, {"x": {"y": {}}}])}


@pytest.fixture()
def small_blocks(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "97b")
    spark.conf.set(names[1], "1b")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def rows(df):
    return sorted(map(repr, df.select("a", "b", "n").collect()))


@pytest.mark.parametrize("seed, indent, ascii_", [(1, None, True), (2, 2, False), (3, None, False)])
def test_equal_to_the_one_task_read(spark, tmp_path, small_blocks, seed, indent, ascii_):
    rng = random.Random(seed)
    for k in range(3):
        made = [record(rng) for _ in range(60)] + [{"a": "x" * 700 + "}" * 300, "n": 1}] + [record(rng) for _ in range(20)]
        (tmp_path / f"{k}.json").write_text(json.dumps(made, indent=indent, ensure_ascii=ascii_), encoding="utf-8")
    found = json_arrays.read_array(spark, str(tmp_path), SCHEMA)
    assert json_arrays._pieces(spark, str(tmp_path), {}).rdd.getNumPartitions() > 30
    assert rows(found) == rows(spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path)))


def test_odd_files(spark, tmp_path, small_blocks):
    for k, text in enumerate(["", "[]", " [ ] \n", "\ufeff[{\"n\": 1}]", "[{\"n\": 2}, 5, \"{\", {\"n\": 3}]\n", "{\"n\": 4}\n{\"n\": 5}", "{\"n\": 6}", "[{}]"]):
        (tmp_path / f"{k}.json").write_text(text, encoding="utf-8")
    got = sorted((r.n is not None, r.n) for r in json_arrays.read_array(spark, str(tmp_path), SCHEMA).collect())
    assert got == [(False, None)] + [(True, n) for n in range(1, 7)]


def test_written_arrays_come_back(spark, tmp_path):
    made = spark.createDataFrame([(f"q{i} }}\"", "d", f"SELECT {i}", None) for i in range(50)], records.QUESTIONS).repartition(3)
    records.write_arrays(made, str(tmp_path / "out"))
    got = records.read_questions(spark, str(tmp_path / "out"))
    assert sorted(r.question for r in got.collect()) == sorted(r.question for r in made.collect())
    assert {r.evidence for r in got.collect()} == {""}
