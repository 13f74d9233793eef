import random

import pytest

from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs."""

    def run(rows):
        return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA)

    return run


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long one, odd characters, repeated rows and ties."""
    r = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "Straße", "año", "x1", "42"]
    long_text = " ".join(r.choice(words) for _ in range(30_000))
    base = " ".join(r.choice(words) + str(r.randrange(500)) for _ in range(120))
    return [
        (1, base),
        (2, base),
        (2, base),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (None, "no id at all here, but words"),
        (None, None),
        (6, long_text),
        (7, "İstanbul ΣΑΣ ǅ   \x1c \x85 日本語 é 🙂 <|endoftext|> a<|startoftext|>b  \n\n x'll DON'T"),
        (8, "one"),
        (9, "one two three"),
        (10, "one two three"),
        (11, base + " tail words that differ"),
        (12, "a" * 5000),
    ]
