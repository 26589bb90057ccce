import random

import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with an extra column whose name is used inside the operators."""

    def make(rows, source="a"):
        made = [(i, t, "en", source if s is None else s, len(t or ""), "x", "y", 7) for i, t, s in ((*r, None)[:3] for r in rows)]
        schema = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, __doc long"
        return spark.createDataFrame(made, schema)

    return make


@pytest.fixture(scope="session")
def prose():
    """Random prose: words of few syllables, with common ones among them."""
    rng = random.Random(9)
    parts = ["an", "the", "er", "on", "ti", "sh", "ré", "eau", "lo", "mu"]

    def text(n, seed=None):
        r = random.Random(seed) if seed is not None else rng
        return " ".join(r.choice(["the", "of", "and"]) if r.random() < 0.3 else "".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))

    return text


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls, empty and long texts, ties and repeated rows."""
    long = prose(6000, seed=1)
    return [(1, prose(80, seed=2)), (2, None), (3, ""), (4, " \t\n"), (None, "no id here"), (5, long), (6, prose(80, seed=2)), (7, "é"), (7, "é"), (8, "a  b \n c  "), (9, "it's <|endoftext|> x"), (None, None)]
