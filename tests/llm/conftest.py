import pytest

ROWS = [
    (1, None, "en", "a", 0),
    (2, "", None, "a", 0),
    (3, "one two three four five six seven eight nine", "en", None, None),
    (4, "one two three four five six seven eight nine", "en", "a", 44),
    (4, "one two three four five six seven eight nine", "en", "a", 44),
    (None, "  \n\t x", "fr", "b", 5),
    (9, "é ü \U0001f600 " * 3000, "de", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    from pyspark.sql import functions as F

    extra = {c: F.lit(7) for c in ("piece", "spans", "score", "shard", "component", "n_words", "kept", "point")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(extra)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    import pandas as pd

    return pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
