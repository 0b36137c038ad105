from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"word{i % 997} of line {i}" for i in range(12_000))
#: Null and empty texts, white space alone, long texts, ties, repeated rows, null ids and columns.
EDGES = [
    (1, None, "en", "a", 0), (2, "", None, "a", None), (3, " \t\n ", "en", None, 3), (4, LONG, "en", "a", len(LONG)), (5, "One two three four five.", "en", "b", 24), (5, "One two three four five.", "en", "b", 24),
    (6, "one TWO three four five.", "de", "b", 24), (7, "Élan <|endoftext|> naïve don't stop  now\n\n\tok 日本語 ½ १२", "fr", "b", 10), (None, "nobody's text, no id", "en", "b", 5), (None, "another one without id", "en", None, 5), (8, "x", "en", "c", 1), (9, "\x1c\x85a\xa0b", "en", "c", 1),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, small):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def twice(spark):
    """Ids that repeat with other texts, of null and empty ones too."""
    return spark.createDataFrame([(1, "a text of one", "en", "a", 1), (1, "another text of one, no copy", "en", "b", 1), (2, None, "en", "a", 1), (2, "", "en", "a", 1), (2, "two has words", None, None, None), (None, "x", "en", "a", 1), (None, "y z", "en", "a", 1)], DOCS)
