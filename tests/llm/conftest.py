from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row long"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma,", "delta", "x1", "né", "ω"]) for _ in range(n))


def frame(spark, rows):
    """documents with further columns whose names clash with the operators' own."""
    full = [(i, t, lang, src, len(t or ""), "clash", 7) for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty texts, ties, repeated rows, a long text, one very common passage."""
    rng = random.Random(5)
    passage = words(rng, 30)
    long = words(rng, 4000)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
    rows = [
        (1, base, "en", "a"), (2, base.replace("w1", "v1", 1), "en", "a"), (3, base, "en", None),
        (3, base, "en", None), (4, None, None, "b"), (5, "", "de", "b"), (6, " \t\n ", "de", "c"),
        (7, "one two", "en", "c"), (8, "ONE two", "en", "c"), (9, long, "fr", "a"), (10, long + " end", "fr", "a"),
        (None, base, "en", "a"), (None, None, None, None),
    ]
    rows += [(20 + i, f"{words(rng, 8)} {passage} {words(rng, rng.randrange(30))}", "en", "a") for i in range(40)]
    rows += [(70, "word " * 300, "en", "d"), (71, "word\n\nword. " * 50, "en", "d")]
    return rows


@pytest.fixture()
def odd(spark, odd_rows):
    return frame(spark, odd_rows)


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
