import random

import pytest

SCHEMA = "doc_id long, text string, lang string, token string, node long, digest string, length int, first_id int"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of (doc_id, text) as a table with more columns, some named as the operators' own."""

    def make(rows, parts: int = 3):
        full = [(i, t, "en", "x", 1, "y", 2, 3) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def prose():
    """Invented sentences; the same for the same seed."""

    def make(seed: int, words: int, vocabulary: int = 400) -> str:
        rng = random.Random(seed)
        names = ["".join(random.Random(i).choices("abcdefghilmnoprstuüé", k=3 + i % 6)) for i in range(vocabulary)]
        return " ".join(rng.choice(names) for _ in range(words))

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls, empty and very long texts, repeated rows and ids, a text of one word."""
    long = prose(99, 20_000)
    return [(1, None), (2, ""), (3, "one"), (4, long), (5, prose(5, 60)), (5, prose(5, 60)), (6, prose(5, 60)),
            (7, prose(6, 40)), (7, prose(8, 40)), (None, prose(5, 60)), (None, None), (8, " \t\n "), (9, "ONE"), (10, "é" * 300)]
