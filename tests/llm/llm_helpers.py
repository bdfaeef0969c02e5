"""Fixtures of the corpus operators' tests."""

import pytest


SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, id string, spans string, text_ string, score double"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents-like rows with columns whose names clash with internal ones."""

    def make(rows):
        full = [(i, t, lang, "s", None if t is None else len(t), "x", "y", "z", "w", 1.0) for i, t, lang in rows]
        return spark.createDataFrame(full, DOCS)

    return make


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in id, text and lang, an empty and a white-space text, repeated rows, a long text."""
    body = prose(1, 120)
    rows = [
        (1, body, "en"), (2, body, "en"), (2, body, "en"), (3, body + " extra tail", "de"), (4, None, "en"), (5, "", None),
        (6, " \n\t ", "en"), (None, body, "en"), (None, None, None), (7, prose(2, 60_000), "en"), (8, "one two", "de"), (12, "a b c", "de"), (13, "a b c d", "de"), (14, "x", None),
        (9, "one two", "de"), (10, "Zoë £ – naïve 日本語 " + prose(3, 40), "fr"), (11, body[:300], "en"),
    ]
    return make_docs(rows)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
