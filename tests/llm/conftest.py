import random

import pytest

#: Extra columns whose names clash with those that operators use inside.
CLASH = {"n": 1, "digest": "x", "sig": "y", "size": 2, "rank": 3, "site": "z", "component": "c", "_id": 5}


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents with nulls, blanks, copies, near copies, repeats and a long text."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    out, doc = [], 0

    def add(text, source="a"):
        nonlocal doc
        out.append({"doc_id": doc, "text": text, "lang": "en", "source": source, "n_chars": len(text or "")} | CLASH)
        doc += 1

    for i in range(60):
        add(" ".join(rng.choices(words, k=rng.randrange(20, 120))), rng.choice(["a", "b", None, "c"]))
    base = rng.choices(words, k=130)
    for i in range(40):
        copy = list(base)
        for _ in range(i % 9):
            copy[rng.randrange(130)] = rng.choice(words)
        add(" ".join(copy))
    for text in (None, "", " \n\t", "One", "one  ONE", "two words", "TWO\nwords", "a" * 50_000):
        add(text, "d")
    for i in range(12):
        add("the same text  again and again" + " " * i, "hot")
    out.append(dict(out[0]))
    out.append(dict(out[3], doc_id=None))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, digest string, sig string, size int, rank int, site string, component string, _id int"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
