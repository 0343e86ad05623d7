import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, rep long, row string, part string, tail string, text_key string, length string, keep_id string"


def table(spark, rows):
    """documents with the given (doc_id, text) and columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1, "x", "x", "x", "x", "x", "x") for i, t in rows], SCHEMA)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
AWKWARD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"),
    (3, None),
    (4, ""),
    (5, "   \n\t  "),
    (6, "one"),
    (7, "two words"),
    (8, LONG),
    (9, LONG + " end"),
    (10, "naïve ünïcode 日本語 😀\nsecond line\r\nthird"),
    (10, "naïve ünïcode 日本語 😀\nsecond line\r\nthird"),
    (11, "same id, first text of two that differ"),
    (11, "same id, second text of two that differ"),
    (None, "a row without an id"),
    (12, "<|endoftext|> is ordinary  here\x00"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return table(spark, AWKWARD)


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
