import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names the operators use inside."""

    def make(pairs):
        rows = [(i, x, "en", "s", None if x is None else len(x), "n", 1.5, 7, [1], "k", 8, 9) for i, x in pairs]
        return spark.createDataFrame(rows, DOCS + ", node string, score double, text_key long, words array<int>, _key string, _text_key long, row int")

    return make


@pytest.fixture(scope="session")
def prose():
    """Invented sentences from a seed."""

    def make(seed, words, size=600):
        pick = random.Random(seed)
        return " ".join("".join(pick.choice("abcdefgh") for _ in range(2 + pick.randrange(4))) for _ in range(words))[:size * 10]

    return make
