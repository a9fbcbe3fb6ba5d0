import pytest

LONG = " ".join(f"word{i % 977}x{i // 977}" for i in range(120_000)) + ". end"
#: Names that operators use themselves.
CLASHING = ("score", "kept", "size", "node", "rep", "hash", "hashes", "group", "y", "row_id", "row_text", "cuts", "key", "cell", "target", "h", "suspect", "component", "gone_id", "item_id", "label")


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, an empty text, white space, a long text, ties, repeated rows and columns with the operators' own names."""
    rows = [(1, "Hello World, foo bar baz."), (2, "hello world, FOO bar baz."), (3, None), (4, ""), (None, "Hello World, foo bar baz."), (5, LONG), (5, LONG), (6, " \n\t "), (7, "é" * 40), (8, "Hello World, foo bar baz.")]
    rows = [(i, t, None if i == 2 else "en", None if i == 3 else f"s{(i or 0) % 2}", len(t or ""), *("x",) * len(CLASHING)) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(1, 9)] + [(None, 1, 0), (2, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
