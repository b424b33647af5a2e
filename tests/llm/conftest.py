import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, size string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i % 977} x{i % 53}" for i in range(60_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1, "x", "y"),
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1, "x", "y"),
        (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "b", 1, None, None),
        (3, None, None, None, None, None, None),
        (4, "", "en", "a", 0, "x", "y"),
        (5, " \t\n ", "en", None, 4, "x", "y"),
        (6, long, "en", "a", len(long), "x", "y"),
        (None, "a row without an id", "en", "b", 3, "x", "y"),
        (None, "a row without an id", "en", "b", 3, "x", "y"),
        (7, "été   naïve 漢字 \U0001f600 ΑΣ don't 'ReD <|endoftext|>", "fr", "c", 9, "x", "y"),
        (8, "one", "en", "c", 3, "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
