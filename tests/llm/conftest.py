import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, score double, findings string"
CASES = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "x", None, "a", 1), (4, "same text here now", "en", "a", 18),
         (5, "same text here now", "en", "b", 18), (6, " \n\t ", "de", "c", 4), (None, "no id at all", "en", None, 12),
         (7, "é" * 3000 + " ü@x.de " * 300, "de", "a", 5400), (8, "word " * 60000, "en", "a", 300000),
         (9, 'token = "0f1e2d3c4b5a69788796a5b4c3d2e1f001234567" end', "en", "z", 54), (9, "second row of an id", "en", "z", 19)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, a missing id, extra columns with clashing names."""
    rows = [(*c, "clash", 0.5, "clash") for c in CASES]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").filter(F.col("doc_id") >= 0)
