from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out boolean, size long, bin long, chunk long, u long"
LONG = " ".join(f"word{i % 97} of {i}" for i in range(9000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew a strong potion in the old stone tower near the river bank " * 3

TEXTS = [
    (1, "Hello World hello world hello"), (2, "hello world HELLO world hello"), (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, "one two"), (8, LONG), (9, LONG + " end"), (10, "prefix a b c " + PASSAGE),
    (11, PASSAGE + " suffix d e f"), (12, "a " * 60), (13, "b " + "a " * 40), (14, "x y " * 30), (15, "x y " * 12 + "z"), (6, "one"), (None, "x y " * 30), (None, None), (16, "été où ça ñandú \x00 é" * 30), (17, "!!! 123 ..."),
]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns whose names clash with the operators' own."""
    rows = [(i, t, ["en", "fr", None][n % 3], [None, "a", "b", "c"][n % 4], len(t or ""), 0.5, True, 7, 1, 2, 3) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
