import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __js string, n_words string"


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(4)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(600)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, sources=("a", "b", None)):
        rows = [(i, t, "en", sources[(i or 0) % len(sources)], len(t or ""), "x", "y") for i, t in texts]
        return spark.createDataFrame(rows, SCHEMA)

    return make
