import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, fp long, node long, words string, _hash long, digest string, label int, _doc int, _text string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with further columns that bear names the operators use themselves."""

    def make(rows, lang=None):
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 1, 2, "w", 3, "d", 4, 5, "u") for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """NULL ids and texts, empty and blank texts, repeated rows, ties, and a very long text."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(4000)}" for _ in range(30000)]
    long_text = "\n".join(" ".join(words[k:k + 10]) for k in range(0, len(words), 10))
    return [(None, None), (None, "only text here"), (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (5, "one"), (6, long_text), (7, long_text), (7, long_text),
            (8, "Ünïcode 日本語 İx <|endoftext|> don't 's"), (9, long_text + "\nend")]
