import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"

ODD = [
    (1, "The cat sat on the mat and looked at the dog", "en", "a", 44, 1),
    (2, None, None, None, None, None),
    (3, "", "en", "b", 0, 1),
    (4, "  two  spaces\n\nand\tlines \n", "en", "a", 10, 1),
    (5, "The cat sat on the mat and looked at the dog", "en", "c", 44, 2),
    (6, "word " * 30000, "en", "c", 150000, 2),
    (7, "é ü 漢字 \U0001f600 <|endoftext|> <s> ▁x", "xx", "b", 9, None),
    (8, "x", "en", "a", 1, 1),
    (None, "no id here, only text", "en", "a", 20, 1),
    (1, "The cat sat on the mat and looked at the dog", "en", "a", 44, 1),
]


@pytest.fixture()
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, an extra column."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
