from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, copy_no string, keep_id string, t string, rank string, __extra string"


@pytest.fixture(scope="session")
def prose():
    """Words of a made-up language, as text of n words."""

    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        syll = ["ba", "ko", "ri", "tu", "me", "sna", "plo", "ve", "dri", "zu"]
        vocab = ["".join(r2.choice(syll) for _ in range(r2.randint(2, 4))) for r2 in [random.Random(99)] for _ in range(3000)]
        return " ".join(r.choice(vocab) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def messy(spark, prose):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, columns with clashing names."""
    x = ["a", "b", "c", "d", "e", "f"]
    long = prose(5, 120_000)
    rows = [
        (1, prose(1, 80), "en", "s1", 10, *x),
        (1, prose(1, 80), "en", "s1", 10, *x),
        (2, prose(1, 80), "en", "s1", 10, *x),
        (3, None, "en", "s1", None, *x),
        (4, "", None, None, 0, *x),
        (5, " \n\t ", "en", "s2", 0, None, None, None, None, None, None),
        (6, long, "en", "s2", 10, *x),
        (7, "?!... ---", "en", "s2", 10, *x),
        (None, prose(2, 80), "en", "s2", 10, *x),
        (None, None, None, None, None, None, None, None, None, None, None),
        (-8, "élève " + prose(3, 60) + " \U0001f600", "fr", None, 10, *x),
        (9, prose(4, 60), "en", "s1", 10, *x),
        (9, prose(7, 60), "en", "s1", 10, *x),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
