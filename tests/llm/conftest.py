import random

import pytest

VOCAB = ["the", "and", "Alpha", "beta,", "gamma", "été", "Δ", "x9", "end.", "of", "rose", "ñandú"]


def words(seed: int, n: int, extra: int = 40) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB + [f"w{k}" for k in range(extra)]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows."""
    same = words(1, 120)
    long = words(2, 30_000)
    return [
        (1, None, "en", "s", 1), (2, "", "en", "s", 1), (3, " \t\n ", "en", None, None), (None, same, None, "s", 3), (4, same, "en", "s", 3), (4, same, "en", "s", 3),
        (4, same + " more", "en", "s", 3), (5, same, "en", "t", 3), (6, long, "fr", "t", 9), (7, "one", None, None, None), (8, "a@b.co +1 (555) 123-4567\npassword=abcdefghijkl0\n1.2.3.4", "en", "t", 1),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, n_lines int, n_dropped string, fingerprint string, score string, kept int, __extra int"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, "x", 1, "y", "z", "w", 5, 7) for r in odd_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
