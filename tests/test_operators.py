"""Operators on small frames: hot keys, ties, repeats and partition counts."""

import random

import pytest
from pyspark.sql import functions as F

from querygrove.functions import minhash
from querygrove.operators import catalog, curation, linking, profiling, rounds, sampling, scoring
from querygrove.operators.joins import HOT_PARTS, hot_keys, hot_salted_lookup, salted_lookup

HOT = [(i, "hot" if i % 3 == 0 else f"k{i % 50}", f"v{i % 7}") for i in range(3000)]


@pytest.fixture(scope="module")
def hot(spark):
    return spark.createDataFrame(HOT, "i int, k string, v string")


def test_salted_lookup_equals_a_plain_join(spark, hot):
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "k string, n int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(tuple, hot.join(lookup, ["k"], how).select("i", "k").collect()))
        for join in (salted_lookup, hot_salted_lookup):
            assert sorted(map(tuple, join(hot, lookup, ["k"], how).select("i", "k").collect())) == plain


def test_hot_keys_are_few_and_spread(hot):
    many = hot.unionByName(hot.select((F.col("i") + 5000).alias("i"), F.concat("k", "i").alias("k"), "v"))
    found = hot_keys(many, ["k"])
    want = {r._key for r in many.groupBy("k").count().filter(F.col("count") * HOT_PARTS > 6000).select(F.xxhash64("k").alias("_key")).collect()}
    assert {r._key for r in found.collect()} == want and len(want) <= HOT_PARTS


def test_first_per_key_is_whole_and_idempotent(hot):
    first = curation.first_per_key(hot, ["k", "v"], ["i"])
    want = {}
    for i, k, v in HOT:
        want.setdefault((k, v), i)
    assert {(r.k, r.v): r.i for r in first.collect()} == want
    assert first.exceptAll(curation.first_per_key(first, ["k", "v"], ["i"])).count() == 0


@pytest.mark.parametrize("partitions", [1, 8])
def test_results_do_not_depend_on_partitions(hot, partitions):
    rows = hot.repartition(partitions)
    half = {r.i for r in sampling.sample_fraction(rows, ["i"], 0.5).collect()}
    assert half == {r.i for r in sampling.sample_fraction(hot, ["i"], 0.5).collect()} and len(half) == 1500
    capped = sampling.cap_per_group(rows, ["k"], ["i"], 5)
    assert max(r["count"] for r in capped.groupBy("k").count().collect()) == 5
    assert {r.i for r in capped.collect()} == {r.i for r in sampling.cap_per_group(hot, ["k"], ["i"], 5).collect()}


@pytest.mark.parametrize("fraction,count", [(0.0, 0), (0.3, 900), (1.0, 3000)])
def test_exact_sample_sizes(hot, fraction, count):
    assert sampling.sample_fraction(hot, ["i"], fraction).count() == count


def test_rank_is_a_permutation_and_split_is_by_question(hot):
    ranks = sorted(r.shuffle_rank for r in sampling.ranked(hot, ["i"]).collect())
    assert ranks == list(range(1, 3001))
    sides = sampling.split(hot, ["k"], 0.5).groupBy("k").agg(F.countDistinct("split").alias("n"))
    assert sides.filter("n > 1").count() == 0


def test_short_lists_cut_the_rows(spark):
    rows = spark.createDataFrame([("q", ["a", "b"], ["x"]), ("r", [], ["y"])], "q string, a array<string>, b array<string>")
    got = curation.explode_results(rows, {"a": "answer", "b": "query"}).collect()
    assert [tuple(r) for r in got] == [("q", 0, "a", "x")]


def test_profile_of_an_empty_table_and_nulls(spark):
    full = spark.createDataFrame([(1, None, -0.0), (1, "b", 0.0), (2, None, 1.5)], "a int, b string, c double")
    empty = spark.createDataFrame([], "z string")
    counts = {r.column_name: r for r in profiling.profile({"full": full, "empty": empty}, "db").collect()}
    assert (counts["z"].n_nonnull, counts["z"].n_distinct, counts["z"].n_null) == (0, 0, 0)
    assert (counts["b"].n_nonnull, counts["b"].n_distinct, counts["b"].n_null) == (1, 1, 2)
    assert counts["c"].n_distinct == 2 and counts["a"].examples == ["1", "2"]


def test_replay_policy(spark):
    rows = [("a", 1, 3, 0, 1), ("a", 2, 9, 1, 1), ("a", 3, 9, 1, 1),  # accepted after round 2
            ("b", 1, None, 0, 1), ("b", 2, 1, 1, 1),                  # unreadable label counts as good
            ("c", 1, 1, 0, 0), ("c", 2, 1, 1, 1),                     # no SQL
            ("d", 1, 1, 0, 1), ("d", 2, 1, 0, 1), ("d", 3, 1, 1, 1), ("d", 4, 1, 1, 1)]
    df = spark.createDataFrame(rows, "sample_id string, round int, judge_label int, label int, has_sql int")
    kept = rounds.replay(df, max_retries=2, threshold=7)
    last = {r.sample_id: (r.round, r.stop_reason) for r in rounds.last_round(kept).collect()}
    assert last == {"a": (2, "accepted"), "b": (1, "accepted"), "c": (1, "no sql"), "d": (3, "retries")}
    overall = rounds.accuracy(kept).filter("is_overall = 1").first()
    assert overall.acc == 0.5 and overall.n_samples == 4
    assert rounds.accuracy(df.limit(0)).filter("is_overall = 1 and acc is not null").count() == 0


def test_schema_recall_bounds(spark):
    columns = spark.createDataFrame([("d", "T", "A"), ("d", "T", "B")], "db_id string, table_name string, column_name string")
    rows = spark.createDataFrame([
        (1, "d", "SELECT A FROM T", "SELECT A FROM T"), (2, "d", "SELECT A, B FROM T", "SELECT A FROM T"),
        (3, "d", "SELECT 1", "SELECT A FROM T"), (4, "d", "SELECT a FROM T", "SELECT A FROM T"), (5, "e", "SELECT A FROM T", "x")],
        "i int, db_id string, gold_query string, generated_query string")
    got = {r.i: r.schema_linking for r in scoring.schema_recall(rows, columns).collect()}
    assert got == {1: 1.0, 2: pytest.approx(2 / 3), 3: None, 4: 0.5, 5: None}


@pytest.mark.parametrize("query,expected", [
    ("SELECT t.a, u.b FROM one AS t JOIN two u ON t.k = u.k", {("one", "a"), ("two", "b"), ("one", "k"), ("two", "k")}),
    ("SELECT a, b FROM two, one WHERE k = 1", {("one", "a"), ("two", "b"), ("two", "k")}),
    ("SELECT one.a, b FROM one JOIN two ON one.k = two.k", {("one", "a"), ("two", "b"), ("one", "k"), ("two", "k")}),
    ("SELECT x.a FROM (SELECT a FROM one) x", {("one", "a")}),
    ("SELECT 'b' FROM one", set()),
    ('SELECT "ONE"."A" FROM "one"', {("one", "a")}),
    ("SELECT a FROM one WHERE k = (SELECT max(k) FROM two WHERE a = b)", {("one", "a"), ("one", "k"), ("two", "k"), ("two", "b")}),
    ("SELECT o.a FROM one o WHERE EXISTS (SELECT 1 FROM two o WHERE o.k = 1)", {("one", "a"), ("two", "k")}),
    ("SELECT k FROM two UNION SELECT b FROM one", {("two", "k")}),
    ("SELECT b FROM (SELECT k FROM two) t, one", {("two", "k")}),
    ("SELECT (SELECT b FROM two t WHERE t.k = one.k) FROM one WHERE (a", {("two", "b"), ("two", "k"), ("one", "k"), ("one", "a")}),
    ("SELECT a FROM main.one m WHERE m.k IN (1, (SELECT count(b) FROM (one JOIN two ON one.a = b)))", {("one", "a"), ("one", "k"), ("two", "b")}),
    ("SELECT extract(year from a), max(k) FROM one GROUP BY a, two", {("one", "a"), ("one", "k")}),
    ("SELECT a FROM one WHERE k IN ((", {("one", "a"), ("one", "k")}),
    ("", set()),
])
def test_columns_by_table(spark, query, expected):
    columns = spark.createDataFrame([("d", "one", "a"), ("d", "one", "k"), ("d", "two", "b"), ("d", "two", "k")],
                                    "db_id string, table_name string, column_name string")
    used = scoring.columns_by_table(spark.createDataFrame([("d", query)], "db_id string, query string"), columns)
    assert {(r.table_name, r.column_name) for r in used.collect()} == expected


def test_composite_is_even_and_in_range(spark):
    random.seed(1)
    rows = [(random.randint(0, 1), float(random.randint(0, 1)), random.random(), random.choice([1.0, random.random()])) for _ in range(200)]
    df = spark.createDataFrame(rows, "a int, b double, c double, d double")
    points = [r[0] for r in df.select(scoring.composite(*[F.col(x) for x in "abcd"])).collect()]
    assert set(points) <= {0, 2, 4, 6, 8, 10}


def test_unknown_metadata_field(spark):
    columns = spark.createDataFrame([("d", "t", "c")], "db_id string, table_name string, column_name string")
    with pytest.raises(ValueError):
        catalog.set_fields(columns, columns, ["colour"])


def test_bare_tables_keep_their_connections(spark):
    columns = spark.createDataFrame([("d", "T", "id", 1, "INT"), ("d", "T", "x", 2, "TEXT"), ("d", "U", "tid", 1, "INT")],
                                    "db_id string, table_name string, column_name string, ordinal int, data_type string")
    keys = spark.createDataFrame([("d", "t", "ID", "pk", None, None), ("d", "u", "TID", "fk", "t", "")],
                                 "db_id string, table_name string, column_name string, kind string, ref_table string, ref_column string")
    chosen = catalog.from_table_names(columns.select("db_id", "table_name"))
    text = catalog.schema_text(chosen, columns, catalog.resolve_keys(keys, columns)).first().schema_text
    assert text == ("CREATE TABLE T\n(\n\tid INT,\n\tPRIMARY KEY (id),\n);\n\n"
                    "CREATE TABLE U\n(\n\ttid INT,\n\tFOREIGN KEY (tid) REFERENCES T (id),\n);")


def test_matches_against_brute_force(spark):
    random.seed(7)
    values = sorted({"Customer#" + "".join(random.choice("0123456789") for _ in range(6)) for _ in range(150)} | {"red widget", "ab", ""})
    probes = [values[3], values[40][:-1] + "x", "red widgit", "ab", "customer = " + values[9]]
    stored = spark.createDataFrame([("d", "t", "c", v) for v in values], "db_id string, table_name string, column_name string, value string").persist()
    keywords = spark.createDataFrame([("d", p) for p in probes], "db_id string, keyword string")

    def grams(text):
        return {text[i:i + 3] for i in range(len(text) - 2)} or {text}
    want = set()
    for p in {r.substring for r in linking.probe_strings(keywords).collect()}:
        scored = [(-len(grams(p) & grams(v)) / len(grams(p) | grams(v)), v) for v in values]
        want |= {(p, v) for s, v in sorted(scored)[:10] if -s >= 0.45}
    got = {(r.substring, r.similar_value) for r in linking.matches(keywords, stored).collect()}
    assert got == want and ("red widgit", "red widget") in got


def test_signature_matches_the_rule(spark):
    text = "abcab"
    row = spark.createDataFrame([(text,)], "t string").select(minhash.signature(F.col("t")).alias("s"), minhash.shingles(F.col("t")).alias("g")).first()
    assert sorted(row.g) == ["abc", "bca", "cab"]
    hashes = [minhash._number(g) for g in row.g]
    assert row.s == [min((a * h + b) % minhash.PRIME for h in hashes) for a, b in minhash.coefficients()]


def test_block_ratio_is_the_library_ratio(spark):
    from difflib import SequenceMatcher
    pairs = [("Red Widgit", "red widget"), ("abc", "xyz"), ("", "")]
    df = spark.createDataFrame(pairs, "substring string, similar_value string")
    got = [r[0] for r in df.select(linking.block_ratio("substring", "similar_value")).collect()]
    assert got == [SequenceMatcher(None, a.lower(), b.lower()).ratio() for a, b in pairs]


def test_similar_entities_step_by_step(spark):
    values = ["red widget", "red wagon", "blue gear", "red widgets"]
    index = linking.value_index(spark.createDataFrame([("d", "t", "c", v) for v in values], "db_id string, table_name string, column_name string, value string")).persist()
    texts = {"red widgit": [1.0, 0.0], "red widget": [0.9, 0.1], "red widgets": [0.5, 0.5], "red wagon": [0.95, 0.0], "blue gear": [1.0, 0.0],
             "red": [0.0, 1.0], "widgit": [0.0, 1.0]}
    vectors = spark.createDataFrame(list(texts.items()), "text string, embedding array<double>")
    keywords = spark.createDataFrame([("d", 1, "red widgit")], "db_id string, request int, keyword string")
    kept = linking.similar_entities(keywords, index, vectors, by=("request",))
    assert {(r.request, r.similar_value) for r in kept.collect()} == {(1, "red widget")}


def test_rounds_from_recorded_texts(spark):
    fence = "`" * 3
    rows = [("s", 1, f"{fence}sql\nSELECT 1\n{fence}", "<reasoning>low</reasoning><label>2</label>"), ("s", 2, "sorry", None)]
    got = rounds.from_responses(spark.createDataFrame(rows, "sample_id string, round int, model_response string, judge_response string"))
    assert [(r.query, r.has_sql, r.judge_label, r.judge_reasoning) for r in got.orderBy("round").collect()] == [
        ("SELECT 1", 1, 2, "low"), ("sorry", 0, None, None)]


def test_tables_used_are_those_named_as_tables(spark):
    columns = spark.createDataFrame([("d", t, "country") for t in ("city", "country", "nation")],
                                    "db_id string, table_name string, column_name string")
    texts = ["SELECT country FROM city", "SELECT 1 FROM City c, nation JOIN country x ON x.country = c.country"]
    queries = spark.createDataFrame([("d", t) for t in texts], "db_id string, query string")
    got = {(r["query"], r.table_name) for r in scoring.tables_used(queries, columns).collect()}
    assert got == {(texts[0], "city"), *((texts[1], t) for t in ("city", "nation", "country"))}


def test_large_columns_stay_in_the_index(spark):
    cells = spark.createDataFrame([("d", "t", "title", "x" * 2_000_001), ("d", "t", "name", "y")],
                                  "db_id string, table_name string, column_name string, value string")
    eligible = cells.select("db_id", "table_name", "column_name")
    assert linking.unique_values(cells, eligible).count() == 2
    lengths = eligible.selectExpr("*", "CAST(2000001 AS BIGINT) AS sum_of_lengths", "CAST(100 AS BIGINT) AS count_distinct")
    assert {r.column_name: r.fit for r in linking.size_gate(lengths).collect()} == {"title": False, "name": True}
