import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = "lang wort " * 30_000
#: doc_id, text, lang, source, and columns that clash with work and output columns.
ROWS = [
    (7, "Alpha beta gamma delta.", "en", "s1"), (3, "Alpha  beta\tgamma delta.", "en", "s1"), (3, "Alpha  beta\tgamma delta.", "en", "s1"),
    (None, "Alpha beta gamma delta.", "en", None), (None, "other words here", "en", None), (1, None, None, "s2"), (2, "", "fr", "s2"),
    (4, " \t\n", "de", "s3"), (5, LONG, "de", "s1"), (6, LONG + "x", "de", "s1"), (8, LONG, "de", "s3"), (9, "Élan É é ß 数字 😀", None, "é"),
    (10, "a", "en", "s1"), (11, "A", "en", "s1"), (12, "12 34 !!", "en", "zero"), (13, "a\nb\nc\nd", "en", "s1"), (14, "x\na\nb\nc\n", "en", "s1"),
]
CLASH = ["kept", "_rid", "size", "score", "ids", "word", "rank", "n_removed"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([r + tuple(f"{c}{i}" for c in CLASH) for i, r in enumerate(ROWS)], schema).repartition(3)


@pytest.fixture(scope="session")
def edge_rows():
    return ROWS


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
