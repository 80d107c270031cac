import pytest
from corpus_rows import SCHEMA, SF, prose, row


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    long_text = prose(1, 30_000) + "\n" + "x" * 5000
    rows = [
        row(1, prose(2, 80)), row(1, prose(2, 80)), row(1, prose(3, 60)), row(2, None), row(3, ""), row(4, "   \n\t "), row(None, prose(4, 70)),
        row(None, None), row(5, long_text), row(6, prose(2, 80), None, None), row(7, "!!!"), row(8, "MIT License\nmit license token=abcdef123456"),
        row(9, "äöü ß İstanbul K ▁ ▁▁   🙂 <|endoftext|> </s>", None, "b"), row(2**60 + 1, prose(5, 55)), row(10, "a  b   c \n d"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
