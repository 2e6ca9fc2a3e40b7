import random

import pytest

#: Columns whose names operators use inside.
CLASHING = "bucket int, data string, score double, kept boolean, n long, k1 long, size long, part double, spots string, copies int, held_out boolean"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
CLASH_ROW = (1, "x", 0.5, True, 3, 4, 5, 0.5, "s", 2, False)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def texts() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empties, one very long text, exact and near copies, repeated rows, shared passages."""
    rng = random.Random(5)
    rows: list[tuple] = [(None, "a null id here", "en", "s1"), (1, None, "en", "s1"), (2, "", None, None), (3, " \t\n ", "en", "s2"), (4, "one", "en", "s2"), (5, "One", "fr", "s3"), (6, "the same again", "en", "s1"), (6, "the same again", "en", "s1"), (None, None, None, None)]
    base = words(rng, 120)
    shared = words(rng, 40)
    for i in range(10, 40):
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 4, 9))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s1"))
    for i in range(40, 60):
        rows.append((i, " ".join(words(rng, 30) + shared + words(rng, 30)), "fr", f"s{i % 3}"))
    rows += [(60, "la " * 60, "fr", "s9"), (61, "la " * 45 + "fin", "fr", "s9"), (62, " ".join(words(rng, 60_000, 5000)), "en", "s2"), (63, "é ü 漢字 😀 x\r\n\x0b y", "xx", "s2"), (64, "x" * 100_000, "en", "s1")]
    rows += [(i, " ".join(words(rng, 25, 60)), "en", "s0") for i in range(70, 110)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, lang, src, len(t or ""), *CLASH_ROW) for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
