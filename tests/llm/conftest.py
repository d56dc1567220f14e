import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sample_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long_text = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "...", "de", None, 3),
            (5, "one two", "en", "b", 7), (5, "one two", "en", "b", 7), (6, "one two", "fr", "b", 7),
            (None, "null id words here now again", "en", "a", 5), (7, long_text, "en", "a", 1), (8, long_text, "de", "a", 1),
            (9, "Ünï çødé " * 40, "xx", "c", 1), (5, "other words for five", "en", "b", 7)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
