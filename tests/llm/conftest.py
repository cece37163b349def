import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType())])


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and a column whose name operators use."""
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words, "en", "a", 5, "x"), (2, words + " more", "en", "a", 5, "x"), (3, "", "en", "b", 0, None), (4, None, None, None, None, None),
            (5, "  \n ", "en", "b", 4, "y"), (6, "two words", "en", "b", 9, "y"), (6, "two words", "en", "b", 9, "y"), (None, "Two  WORDS", "de", None, 9, "z"),
            (8, "long " * 30_000, "fr", "c", 150_000, "z"), (9, "x" * 50_000, "fr", "c", 50_000, "z"), (10, words.upper(), "en", "a", 5, "x")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
