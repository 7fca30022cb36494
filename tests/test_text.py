"""Column functions on edge cases, against values written out."""

import pytest
from pyspark.sql import functions as F

from querygrove.functions import prompts, rewards, sqltext
from querygrove.functions.text import strip

FENCE = "`" * 3
TEXTS = [
    "", " ", "plain", " \u00a0 select 1 \u3000", f"{FENCE}sql\nselect 1\n{FENCE}",
    f"a {FENCE}sql select 1 {FENCE} b {FENCE}sql\n\nselect 2;\n{FENCE}", f"{FENCE}SQL select 3 {FENCE}",
    f"{FENCE}sql never closed", f"{FENCE}sql{FENCE}",
]
SQLS = [
    "", "SELECT a FROM t", "select  A\n\tfrom T ;", "select a from t;;", "SELECT a -- note\nFROM t", "SELECT '--x' FROM t",
    "/* a\nb */ SELECT ( a , b ) FROM t", "select 'It''s', \"q\" from t", "SELECT a\u00a0,\u3000b", "-- only",
    r"SELECT \'a\' , \\\"b\\\" FROM t",
]
RESPONSES = [
    "", "<label>7</label>", "<label> 99 </label>", "<label>-1</label>", "<label>7.5</label>", "<label>x</label><label>3</label>",
    "<reasoning>\nr\n</reasoning>\n<label>\n5\n</label>", "<reasoning>\na\n</reasoning>\n<reasoning>\n</reasoning>\n<label>\n5\n</label>",
    " <reasoning>a</reasoning> <label>b</label> ", "x<reasoning>a</reasoning><label>b</label>y", "<label>\u0663</label>",
    "<label>123456789012345678901234567890</label>", "<reasoning> \n why \n</reasoning><label>+4</label>",
]


# What each text above gives, written out.
EXTRACTED = [
    '',
    '',
    'plain',
    'select 1',
    'select 1',
    'select 2;',
    '```SQL select 3 ```',
    '```sql never closed',
    '',
]
NORMAL = [
    '',
    'select a from t',
    'select a from t ',
    'select a from t',
    'select a from t',
    "select '",
    'select(a,b)from t',
    'select \'it\'\'s\',"q" from t',
    'select a,b',
    '',
    'select \\\'a\\\',\\\\\\"b\\\\\\" from t',
]
CLEAN = [
    '',
    'SELECT a FROM t',
    'select  A \tfrom T ;',
    'select a from t;;',
    'SELECT a -- note FROM t',
    "SELECT '--x' FROM t",
    '/* a b */ SELECT ( a , b ) FROM t',
    "select 'It''s', 'q' from t",
    'SELECT a\xa0,\u3000b',
    '-- only',
    "SELECT 'a' , 'b' FROM t",
]
LABELS = [-1, 7, 99, -1, -1, 3, 5, 5, -1, -1, 9223372036854775807, -1]
TAG_REWARDS = [-0.5, 0, 0, -0.5, -0.5, 0, 0.5, 0.25, -0.5, -0.5, 0, -0.5]
STRICT = [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5, 0.5, 0.5, 0.0, 0.0, 0.5]
SOFT = [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5, 0.5, 0.5, 0.5, 0.0, 0.5]


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_strip(spark):
    assert values(spark, TEXTS, strip) == [t.strip() for t in TEXTS]


def test_extract(spark):
    assert values(spark, TEXTS, sqltext.extract_sql) == EXTRACTED
    kept = values(spark, TEXTS, lambda c: sqltext.extract_sql(c, strip_plain=False))
    assert kept[3] == TEXTS[3]


def test_normalize(spark):
    assert values(spark, SQLS, sqltext.normalize_sql) == NORMAL


def test_normalize_ignores_case_blanks_and_comments(spark):
    same = ["SELECT a,b FROM t", "select  A ,\n b from T -- x", "/* y */ SELECT a , b\tFROM t;"]
    assert len(set(values(spark, same, sqltext.normalize_sql))) == 1
    tails = ["select 1 ;", "select 1; ;", "select 1"]
    assert len(set(values(spark, tails, lambda c: sqltext.normalize_sql(c, trim_tail=True)))) == 1


def test_clean(spark):
    got = values(spark, SQLS, lambda c: sqltext.clean_sql(c, strip_comments=False))
    assert got == CLEAN
    assert values(spark, ["SELECT a -- b\nFROM t", "SELECT '--x' -- y"], sqltext.clean_sql) == ["SELECT a  FROM t", "SELECT '--x' "]


@pytest.mark.parametrize("query,expected", [
    ("SELECT p.a AS x FROM t AS p JOIN u q ON p.i = q.i", {"x", "p", "q"}),
    ("SELECT CAST(a AS INTEGER) AS n, count(*) c FROM t WHERE b = ' as z'", {"n", "c"}),
    ("SELECT a FROM t WHERE a IN (1, 2) AND b > 0", set()),
    ("SELECT m.c FROM (SELECT max(a) AS c FROM t) m", {"c", "m"}),
    ("SELECT a FROM t ORDER BY a", set()),
    ("SELECT a FROM t JOIN u x ON t.a = x.a LEFT JOIN v ON v.a = x.a", {"x"}),
])
def test_aliases(spark, query, expected):
    assert set(values(spark, [query], sqltext.aliases)[0]) == expected


def test_ngrams_and_jaccard(spark):
    queries = ["SELECT p.a AS x FROM t AS p", "select a from t", "", "one"]
    words = values(spark, queries, lambda c: sqltext.ngrams(c, 1))
    assert set(words[0]) == {"select", "a", "from", "t"} and words[2] == []
    pairs = values(spark, queries, lambda c: sqltext.ngrams(c, 2))
    assert set(pairs[1]) == {"select a", "a from", "from t"} and pairs[3] == []
    both = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], ["a"])], "l array<string>, r array<string>")
    got = both.select(sqltext.jaccard(F.col("l"), F.col("r")), sqltext.jaccard(F.col("r"), F.col("l"))).collect()
    assert [r[0] for r in got] == [r[1] for r in got] == [pytest.approx(1 / 3), 0.0, 1.0]


def test_labels(spark):
    assert values(spark, RESPONSES[:10] + RESPONSES[11:], rewards.label) == LABELS
    assert values(spark, RESPONSES, rewards.judge_label)[-1] == 4
    assert values(spark, RESPONSES, rewards.judge_reasoning)[-1] == "why"


def test_rewards(spark):
    texts = RESPONSES[:10] + RESPONSES[11:]
    assert values(spark, texts, rewards.tag_reward) == pytest.approx(TAG_REWARDS)
    near = values(spark, ["<label>6</label>", "<label>8</label>", "none"], lambda c: rewards.accuracy_reward(c, F.lit(6)))
    assert near == pytest.approx([2.0, 0.7357588823428847, -1.0])
    assert values(spark, texts, rewards.strict_format_reward) == STRICT
    assert values(spark, texts, rewards.soft_format_reward) == SOFT


def test_prompt_is_filled_once(spark):
    text = values(spark, ["{HINT} %s"], lambda c: prompts.render("100% {QUESTION} {HINT}", {"QUESTION": c, "HINT": F.lit("h")}))
    assert text == ["100% {HINT} %s h"]
    with pytest.raises(FileNotFoundError):
        prompts.load_template("missing")


def test_messages_round_trip(spark):
    row = spark.createDataFrame([('a "b"\n\u00e9',)], "t string").select(
        prompts.decode_messages(prompts.encode_messages(prompts.messages(F.col("t")))).alias("m")).first()
    assert [m.role for m in row.m] == ["system", "user"] and row.m[1].content == 'a "b"\n\u00e9'
