import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, q string, kept string, id string, th string, fp string, low int, key string, bucket int, bytes string"
CLASH = ("x",) * 6 + (1, "x", 2, "x")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text), with columns that clash with the operators' own names."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *CLASH) for i, t in rows], DOCS)

    return make


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary):03d}{'abcdefgh'[rnd.randrange(8)]}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with nulls, an empty one, copies, near copies, a shared line and passage, repeated and null ids, a long one."""
    rnd = random.Random(7)
    base = [words(rnd, rnd.randrange(30, 120)) for _ in range(30)]
    passage, line = words(rnd, 120), "This very line is shared by many of the documents."
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(40, base[3]), (41, base[3]), (42, base[4] + " extra"), (43, None), (44, ""), (45, "   \n\t\n"), (46, "a"), (None, base[5]), (None, words(rnd, 50))]
    rows += [(50 + i, words(rnd, 20) + " " + passage + " " + words(rnd, 20)) for i in range(3)]
    rows += [(60 + i, f"{words(rnd, 15)}\n  {line.upper() if i else line}\n{words(rnd, 15)}\n{line}") for i in range(4)]
    rows += [(70, words(rnd, 9000)), (71, "été Straße ñandú " * 40), (72, "é" * 900), (1, base[1]), (2, words(rnd, 40))]
    return rows
