import random

import pytest

SCHEMA = "doc_id long, text string, lang string, fingerprint string, component_id long, extra string, answers int, n_words long"


def prose(rng, n):
    return " ".join("".join(rng.choice(("th", "an", "er", "on", "ti")) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty, white space, odd characters, copies, near copies, shared
    passages, repeats within a text, one long text."""
    rng = random.Random(5)
    base = prose(rng, 300)
    shared = prose(rng, 60)
    out = [None, "", " \t\n ", "x", "Ab\x00c\x1c d　e", "a<|endoftext|>b <|StartOfText|> c", "日本語 ✓ " * 30, base, base, base.upper().lower(), base + " tail", base.replace("th", "zz", 1)]
    out += [f"{prose(rng, 50)} {shared} {prose(rng, 40)}\nnotice {i} for page {i * 7}\nAll rights reserved here now.\n{prose(rng, 9)}" for i in range(6)]
    out += [shared, " ".join([prose(rng, 12)] * 20), "a" * 3000, prose(rng, 20_000), "\n\n".join(prose(rng, 8) for _ in range(40))]
    return out


@pytest.fixture(scope="session")
def documents(spark, texts):
    rows = [(i * 3, t, "en", "f", -1, "e", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def nameless(spark):
    return spark.createDataFrame([(None, "some words here to read", *["x"] * 2, 0, "e", 1, 2), (None, None, *["x"] * 2, 0, "e", 1, 2), (4, "some words here to read", *["x"] * 2, 0, "e", 1, 2)], SCHEMA)
