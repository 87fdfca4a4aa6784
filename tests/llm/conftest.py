"""Small documents with the cases that every operator must bear."""

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed=0):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 9)) * (r.random() < 0.3) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties, and extra columns with clashing names."""
    long = prose(4000, 1)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, prose(60, 2)), (5, prose(60, 2)), (6, prose(60, 2)), (7, prose(300, 3)), (8, long), (9, prose(60, 2) + " extra"), (10, "é😀 中文 mail a.b@c.de and +1 (234) 567-8901 10.0.0.1 4111 1111 1111 1111")]
    return spark.createDataFrame([(i, t, None if i % 2 else "x", i, 1.0) for i, t in rows], "doc_id long, text string, lang string, key long, score double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
