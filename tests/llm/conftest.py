import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ka mo ri te su no ha vel dor min tas pel gra shu lon".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def corpus():
    """Rows of documents with every awkward case: null and empty texts, null ids, repeated rows, a very long text, near and exact copies, toxic and poor ones."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        rows.append([i, " ".join(words(rng, 80)) + "."])
    for i in range(60, 70):  # near copies
        w = rows[i - 60][1].split()
        w[rng.randrange(80)] = "changed"
        rows.append([i, " ".join(w)])
    rows += [[70, rows[0][1]], [71, rows[0][1]], [72, None], [73, ""], [74, "one"], [75, "one two"], [76, "one two"], [77, "!!! ???"], [None, rows[3][1]], [78, " ".join(words(rng, 60_000))]]
    for i in range(80, 100):
        w = words(rng, 60)
        w[10:10] = ["you", "stupid", "idiot"]
        rows.append([i, " ".join(w)])
    for i in range(100, 130):
        rows.append([i, " | ".join(words(rng, 60)).upper() + " ###"])
    out = [(i, t, None if i == 5 else "en", None if i == 6 else f"src{(i or 0) % 3}", len(t) if t else None) for i, t in rows]
    return [*out, out[1], out[1]]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 0 if 100 <= i < 130 else 1, 1 if 80 <= i < 100 else 0) for i in range(130) if not 70 <= i < 80]
    return spark.createDataFrame([*rows, (None, 1, 0), (3, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with further columns named as the operators' own."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("score", "p", "keep", "toxic", "h1", "cells", "size", "point", "tile", "block", "doc_a", "tokens", "n", "key", "part", "y", "copy", "rep", "docs")})
