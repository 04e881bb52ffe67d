import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, body string, label string, size string, target string, key string, _range string, mark string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, equal texts, and columns with clashing names."""
    words = [f"word{k % 97}x{k % 13}" for k in range(30_000)]
    texts = [
        (1, "the quick brown fox jumps over the lazy dog again and again\nshared line of five tokens", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog again and again\nshared line of five tokens", "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \n\t ", "en", "b"),
        (6, " ".join(words), "en", "b"),
        (6, " ".join(words), "en", "b"),
        (6, "same id but another text here\nshared line of five tokens", "en", None),
        (None, "a text without an id at all\nshared line of five tokens", None, "b"),
        (7, "x" * 50_000, "de", "c"),
        (8, "Released under the MIT License.", "en", "c"),
        (9, "日本語 😀 é ß ▁ <|endoftext|> don't", "de", "c"),
        (10, "z", "en", "d"),
    ]
    rows = [(i, t, lang, s, None, "n", "b", "l", "s", "t", "k", "r", "m") for i, t, lang, s in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
