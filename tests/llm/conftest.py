import random

import pytest

#: Columns that a table may have beside those that operators read; their names clash with inner ones.
EXTRA = tuple(
    "k places score size target fp key node held rid w s epochs start rest bucket cut_source cut_key cut_size mix_key mix_of row_key row_places __key __k __places "
    "source_size u v root shard mine gram label base toxic tid i j diag merged span sym rest_known c".split()
)


def prose(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(17)


@pytest.fixture
def frame(spark):
    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        return df.selectExpr("*", *(f"'x' AS {c}" for c in EXTRA)) if extra else df

    return make


ODD = [(None, "null id with some words", None, None, None), (9001, None, None, None, None), (9002, "", "en", "a", 0), (9003, " \t\n ", "en", "a", 4), (9004, "é" * 3000 + " " + "long " * 40000, "fr", None, 1), (9005, "same row", "en", "b", 8), (9005, "same row", "en", "b", 8)]


@pytest.fixture
def odd():
    return list(ODD)
