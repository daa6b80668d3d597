"""Small tables for the operators on documents."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, items long, score double, key string"


def words(rng, n, size=400):
    """Words of letters, as digits are alike to some operators."""
    return " ".join("w" + "".join(chr(97 + int(c)) for c in str(rng.randrange(size))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, repeated rows, ties, near and exact copies; and columns with clashing names."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(words(rng, rng.randrange(5, 60)) + "." for _ in range(rng.randrange(1, 6))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "c", None]), 0, 1.5, "k"))
    long = words(rng, 6000)
    rows += [(100, long, "en", "a", 1, None, None), (101, long.replace("wb ", "wc ", 20), "en", "a", 1, None, None)]
    rows += [(102, None, None, None, None, None, None), (103, "", "en", "b", 0, 0.0, ""), (104, "!!! --- ...", "en", "b", 0, 0.0, ""), (None, "no id here at all but words enough", "en", "a", 1, None, None)]
    base = rows[7][1]
    rows += [(110 + i, base, "en", "a", 0, 0.0, "x") for i in range(8)]
    rows += [(130 + i, base.replace(" ", " ", 1) + f" tail{i}", "en", "b", 0, 0.0, "x") for i in range(6)]
    rows += [(150, "same row twice over and over", "en", "a", 0, 0.0, "x")] * 3 + [(150, "another text under this id", "en", "a", 0, 0.0, "x")]
    rows += [(160, "a b", "en", "a", 0, 0.0, "x"), (161, "a  B", "en", "a", 0, 0.0, "x"), (162, "Käse ist gut 123", "de", "c", 0, 0.0, "x")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
