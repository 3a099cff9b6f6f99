import pytest


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


#: Rows with nulls in any column, empty and blank texts, ties, repeated rows and a long text.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 1),
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 1),
    (2, None, "en", None, None),
    (3, "", None, "b", 0),
    (4, " \t\n ", "de", "b", 0),
    (None, "a text without an id", None, None, None),
    (5, "word " * 30000, "en", "a", 150000),
    (6, "The quick brown fox jumps over the lazy dog near the old river bank today!", "en", "a", 1),
    (7, "two words", "en", "a", 9),
]


@pytest.fixture
def odd_docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    # Columns whose names operators might use themselves.
    return df.withColumns({"id": F.lit("x"), "key": F.lit(1), "w": F.lit(2), "kept": F.lit("y"), "host": F.lit("z"), "n": F.lit(3)})
