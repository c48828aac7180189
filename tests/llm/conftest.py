import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Columns that clash with names the operators use.
    T.StructField("score", T.StringType()), T.StructField("slot", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("bits", T.StringType())])

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing columns."""

    long_text = "alpha beta gamma delta epsilon zeta " * 20_000
    rows = [
        (1, None, "en", "a", 0, "x", "y", "z", "w"), (2, "", None, None, None, None, None, None, None),
        (3, " \t\n\x0b ", "en", "a", 5, "x", "y", "z", "w"),
        (4, long_text, "en", "a", len(long_text), "x", "y", "z", "w"),
        (5, long_text, "en", "b", len(long_text), "x", "y", "z", "w"),
        (5, long_text, "en", "b", len(long_text), "x", "y", "z", "w"),
        (None, "one two three four five six", "fr", "b", 27, "x", "y", "z", "w"),
        (None, "One TWO three four five six", None, "b", 27, "x", "y", "z", "w"),
        (7, "1234 !!! 99", "fr", "c", 11, "x", "y", "z", "w"),
        (8, "a", "fr", "c", 1, "x", "y", "z", "w")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
