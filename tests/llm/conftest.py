import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, component_id string"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names."""
    long = " ".join(f"word{k % 5000} x{k}" for k in range(60_000))
    lines = "The first line is here.\nThe second line is there.\nThe third line is last.\nA fourth one ends."
    rows = [
        (1, "Hello there, write to a.b@mail.example.com or +1 (555) 123-4567 now.\n" + lines, "en"),
        (2, lines, "en"),
        (2, lines, "en"),
        (3, lines.upper(), None),
        (4, "", "en"),
        (5, None, "en"),
        (None, "no id here\n" + lines, "en"),
        (None, None, None),
        (6, long, "en"),
        (7, "\n\n\n \t\n", "en"),
        (8, "é ü ß 漢字 🙂 İ ﬁ́ <|endoftext|> 10.0.0.1 4111 1111 1111 1111", "de"),
        (9, "same words " * 40, "en"),
        (9, "other words with the id nine again", "en"),
    ]
    return spark.createDataFrame([(i, t, x, "src", None if t is None else len(t), "clash", "clash") for i, t, x in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
