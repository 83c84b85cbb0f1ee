import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, size string, gram string"


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(n)]


def documents() -> list[tuple]:
    """Nulls in each column, empty and long texts, copies, near copies, repeated rows; the last four columns only clash."""
    rng = random.Random(5)
    base = [" ".join(words(rng, rng.randint(1, 120))) for _ in range(40)]
    near = [" ".join(base[3].split()[:-1] + [f"x{k}"]) for k in range(6)]
    texts = base + near + [base[0], base[0] + "  ", base[1].upper(), "\t\n", "", None, "a b", "a b", "one", "É ü 漢字 😀 \x00 x", " ".join(words(rng, 30_000)), "x" * 100_000]
    rows = [(k, t, "en", ["s1", "s2", None, "s3"][k % 4], len(t or ""), "c", "c", "c", "c") for k, t in enumerate(texts)]
    rows += [(None, "no id", None, None, None, None, None, None, None), (7, base[7], "en", "s1", 1, "c", "c", "c", "c"), (7, base[7], "en", "s1", 1, "c", "c", "c", "c"), (8, "another text with an id that stands twice", "en", "s1", 1, "c", "c", "c", "c")]
    return rows


@pytest.fixture(scope="session")
def doc_rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
