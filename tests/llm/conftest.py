import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc string, row int, n bigint, key string, node string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows; further columns with clashing names."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "été", "naïve", "日本語", "x1", "12", "idiot"]
    make = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ".", "\n"]) for _ in range(n))
    base, passage = make(60), make(90)
    texts = [None, "", " ", "\n\n", "a", "  two  words ", base, base, base.upper(), base + " tail", make(3000), passage + make(50), make(40) + passage, "The same long line here\n" + make(5), make(4) + "\nthe SAME long line here \n", "don't 's 'll\r\n<|endoftext|> x\u0000y"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t), "d", 1, 2, "k", None) for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, base, "en", "s1", 1, "d", 1, 2, "k", None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
