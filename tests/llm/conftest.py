"""Small documents with the cases that every operator has to stand."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, row string"
WORDS = "the of and time house water people small great never every under light story river stone glass paper".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def prose_of():
    return prose


@pytest.fixture(scope="session")
def docs(spark):
    base = [prose(i, 60 + i) for i in range(12)]
    texts = [*base, base[3], base[4] + " end", None, "", "   \n\t ", "one two", "ONE two", base[5], prose(99, 12000), "x" * 70000, "mail a.b@mail.example.com or 4111 1111 1111 1111 and +1 (297) 555-8151 at 10.1.2.3", base[0] + "\n" + base[0] + "\n" + base[0]]
    rows = [(i, t, ["en", "de", None][i % 3], [None, "a", "b", "a", "a"][i % 5], len(t or ""), 7, "x", "y") for i, t in enumerate(texts)]
    rows += [(None, base[1], None, None, 3, None, None, None), rows[2], (5, "another text under an id that is taken", "en", "a", 1, 1, "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
