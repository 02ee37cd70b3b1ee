import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start long, ids string, score string, spans string, bucket string"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_texts():
    """Nulls, empty and very long texts, ties, repeated rows, odd white space, and passages in common."""
    passage = words(1, 60)
    return [
        (0, words(2, 80)),
        (1, None),
        (2, ""),
        (3, " \t\n\x0b"),
        (4, words(3, 40) + passage + words(4, 20)),
        (5, words(5, 30) + passage),
        (5, words(5, 30) + passage),  # a repeated row
        (6, words(2, 80)),  # a copy
        (7, words(2, 79) + " changed"),
        (8, "one"),
        (9, "One"),
        (10, "a" * 1000),
        (11, words(6, 30000)),
        (12, "É x  y\r\n<|endoftext|> don't 12³ 漢字😀\x1c!"),
        (None, words(7, 50)),
        (13, "x y " * 100),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_texts):
    """Extra columns have names that operators use for their own."""
    rows = [(i, t, "en" if (i or 0) % 3 else None, "s", len(t or ""), 7, "x", "x", "x", "x") for i, t in edge_texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
