import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def workers_find_the_package(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


@pytest.fixture()
def frame(spark):
    """A documents table with clashing extra columns from (doc_id, text) rows."""

    def make(rows):
        full = [(d, t, "x", 1, "y") for d, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, row_key string, node int, spans string")

    return make


# Nulls, empty and white-space texts, ties, repeated rows, one very long word and a long text.
EDGE_ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (None, None), (7, "x " * 300),
    (7, "x " * 301), (8, "the same words stand here twice"), (8, "the same words stand here twice"), (9, "w" * 20_000),
    (10, "é ü\xa0ß\x0b漢字 <|endoftext|> \x1c " * 40), (11, " ".join(f"w{i}" for i in range(5000))),
]
