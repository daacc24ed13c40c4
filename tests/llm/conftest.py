import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, __h string, class_id string, `a b.c` int"


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls in every column, empty and blank texts, repeated rows, copies, a long text; extra columns that clash."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    prose = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
    base = [
        (1, prose, "en", "a"), (1, prose, "en", "a"), (2, prose.upper(), "en", "a"), (3, prose + " end", "en", "b"), (None, prose, None, None),
        (None, None, None, None), (4, None, "en", None), (5, "", "fr", "a"), (6, " \n\t ", "fr", "b"), (7, "one two", None, "b"), (8, long, "de", "c"),
        (9, "x" * 50_000, "de", "c"), (10, "é\u00a0ñ 中文 😀 a", "es", "c"), (11, "one two", "en", "a"),
    ]
    return [(*r, len(r[1] or ""), "k", "s", "h", "c", 5) for r in base]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(hard):
    return hard.where("false")
