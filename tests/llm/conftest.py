import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long").add("size", "string").add("node", "string")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(12_000))
PROSE = "Many small rivers meet below the old stone bridge,\nwhere the market opens on most mornings and closes when the rain begins to fall. " * 2


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, PROSE, "en", "a", 1, "x", "y"), (2, PROSE, "en", "a", 1, None, None), (2, PROSE, "en", "a", 1, None, None), (3, None, None, None, None, None, None),
        (None, "", "en", None, 0, None, None), (None, PROSE + " more words at the very end", None, "b", None, None, None), (7, LONG, "de", "b", None, None, None),
        (8, "   \n\t ", "de", "b", 3, None, None), (9, "x" * 50_000, "de", "c", None, None, None), (2**53 + 1, "ein  Wort\r\n\r\nmehr <|endoftext|> ▁ 😀", "de", "c", None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
