import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, kept string, `row` int"


def prose(seed: int, n: int, words=("the", "of", "tion", "ander", "ing", "th", "er", "sha", "Leaux", "één", "x1")) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, clashing column names."""
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    shared = prose(5, 30)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, " ".join(near), "en", None), (4, None, None, None), (5, "", "en", "a"),
        (6, "   \n\t ", "fr", "a"), (7, prose(7, 40) + " " + shared + " " + prose(8, 40), "fr", "b"), (8, shared, "fr", "c"),
        (9, prose(9, 6000), "en", "c"), (10, "aaaa" * 400, None, "c"), (11, "one", "en", "c"), (11, "one", "en", "c"),
        (12, "Write to Anna: anna.b@mail.example.com or +44 20 7946 0958, host 10.0.0.255.", "en", "a"),
        (13, "one", "en", "a"), (14, base.upper(), "en", "a"), (15, "日本語 ▁ <|endoftext|>  tail \x01 , . x", None, "b"),
        (None, base, "en", "a"),
    ]
    return [(i, t, g, s, len(t or ""), "clash", "clash", 1) for i, t, g, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
