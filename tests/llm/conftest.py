import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, key long, `__id` long, `__n` long, lowered string, keep string, votes string, part int, kept string"
EXTRA = ("r", "d", 1, 2, 3, "l", "k", "v", 4, "kk")


def words(dice, n, size=400):
    return " ".join(f"w{dice.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    def f(rows):
        return spark.createDataFrame([(i, t, lang, source, len(t or ""), *EXTRA) for i, t, lang, source in rows], SCHEMA)

    return f


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and very long texts, ties and repeated rows, clashing names."""
    dice = random.Random(2)
    long = "\n".join(words(dice, 12) + "." for _ in range(3000))
    some = [words(dice, 60) + "." for _ in range(6)]
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\n ", "fr", None), (None, some[0], "en", "b"), (None, None, None, None), (4, some[1], None, "b"), (4, some[1], None, "b"), (5, some[1], "en", "a"), (6, long, "en", "a"), (7, "x", "de", "b"), (8, "\0 ü 漢字 🙂", "zz", "a"), (9, some[2] + "\n" + some[2], "en", "b"), (4, some[3], "en", "b")]
    return make(rows)


@pytest.fixture(scope="session")
def none(make):
    return make([])
