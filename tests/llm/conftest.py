import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, blanks, copies, repeated rows, a long text, and a column whose name clashes."""
    copy = "One two three four five six seven eight nine ten. " * 4
    long = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
    rows = [(1, copy, "en", "src1", None, "a"), (2, copy, "en", "src0", 3, "b"), (2, copy, "en", "src0", 3, "b"),
            (3, None, None, None, None, None), (4, "", "de", "src2", 0, None), (5, " \n\t ", "de", "src2", 4, None),
            (None, copy + " tail", "en", None, None, None), (6, long, "en", "src0", None, "c"),
            (7, "é" * 150 + " " + copy, "fr", "none", None, None), (None, "Quite another text that nothing else repeats at all.", None, None, 9, "d"),
            (2, "A second text under an id that others have too, with words of its own: " + " ".join(f"z{k}" for k in range(60)), "en", "src0", 1, "e")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
