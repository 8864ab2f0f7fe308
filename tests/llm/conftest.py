import random

import pytest

LANGS = {"aa": "the of and to in that with from this have".split(), "bb": "der die und das nicht ein mit auf sich den".split()}


def prose(r: random.Random, lang: str, n: int) -> str:
    letters = "aeiou" + ("rstlnw" if lang == "aa" else "zkgchb")
    words = [r.choice(LANGS[lang]) if r.random() < 0.4 else "".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))


@pytest.fixture(scope="session")
def prose_of():
    return prose


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and blank texts, a very long one, one without letters, repeated rows, rows without an id."""
    r = random.Random(5)
    long = prose(r, "aa", 40_000)
    own = prose(r, "bb", 60)
    return [(900, None), (901, ""), (902, " \n\t "), (903, long), (904, "12 34 !! 56"), (905, own), (905, own), (None, own), (None, None), (906, "x"), (907, "é" * 3 + "日本 \U00012000 ́"), (908, "<|endoftext|> don't  stop\n\n now ")]


@pytest.fixture(scope="session")
def with_clashes():
    """Adds columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ["score", "kept", "language", "statistics", "bands", "node", "piece", "shard", "rank", "lang", "key1", "toxicity"]
    return lambda df: df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names) if n not in df.columns])
