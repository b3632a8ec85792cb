import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __w string, key string, doc string"
#: Nulls in every column, empty, blank and long texts, repeated rows and texts, names that operators use themselves.
WORDS = " ".join(f"w{i % 97}x{i}" for i in range(400))
ROWS = [
    (1, WORDS, "en", "a", 5, "x", "k", "d"),
    (1, WORDS, "en", "a", 5, "x", "k", "d"),
    (2, WORDS + " and more", "en", "a", 5, "x", "k", "d"),
    (3, None, None, None, None, None, None, None),
    (None, "one two three four", "en", "a", 1, "", "", ""),
    (5, "", "en", None, 0, "x", "k", "d"),
    (6, " \t\n ", "fr", "b", 4, "x", "k", "d"),
    (7, "single", "fr", "b", 6, "x", "k", "d"),
    (8, ("again and again " * 3000).strip(), "fr", "b", 6, "x", "k", "d"),
    (9, "naïve café — 漢字 🙂\x0bvertical", "de", "b", 6, "x", "k", "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
