import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def vocab():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def prose(vocab):
    """Some words of invented prose; the same for the same seed."""

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(vocab) + ("." if rng.random() < 0.1 else "") for _ in range(n))

    return make


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of (doc_id, text), or of (doc_id, text, source), as a documents table."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls, empty and blank texts, repeated rows, ties, a long text, unusual characters."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "b c"), (None, None), (5, prose(9, 30)), (5, prose(9, 30)), (6, prose(1, 30000)), (7, "a\x1cb\x85c\xa0d é　f \x00 g"), (8, "x" * 5000)]
